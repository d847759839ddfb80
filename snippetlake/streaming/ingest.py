"""Ingest of a stream of file versions, as incremental upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.encode import Encoder
from ..plans.ingest import upsert
from ..sources.store import VectorStore


def latest_versions(files: DataFrame) -> DataFrame:
    """One row per path, the last modified; decided on narrow rows before texts move."""
    last = files.groupBy("path").agg(F.max(F.struct("mtime", "md5")).alias("last")).select("path", "last.mtime", "last.md5")
    return files.join(last, ["path", "mtime", "md5"]).dropDuplicates(["path"])


def ingest_stream(files: DataFrame, store: VectorStore, encoder: Encoder, checkpoint: str, name: str = "ingest", **options) -> StreamingQuery:
    """Start upserting a stream of ``(path, content, md5, mtime, tree)``.

    Each micro-batch is one batch of the table, tagged by the query's own id (which its
    checkpoint keeps), the encoder and the batch number: a retry of a batch that was already
    committed does nothing, and no other stream, model or checkpoint shares its tag. It takes what is available and stops.
    """

    def apply(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        upsert(store, latest_versions(batch), encoder, tag=f"{query}:{encoder.name}:{number}", **options)

    return (
        files.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .queryName(name)
        .trigger(availableNow=True)
        .start()
    )
