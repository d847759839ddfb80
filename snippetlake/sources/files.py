"""Source and parse-tree files, from a folder or from a table holding their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import uri_to_path
from ..functions.text import normalize_newlines


def read_binary_files(spark: SparkSession, *roots: str) -> DataFrame:
    """``(path, bytes, mtime)`` of all files below the roots."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    return scan.select(
        uri_to_path(F.col("path")).alias("path"),
        F.col("content").alias("bytes"),
        F.col("modificationTime").alias("mtime"),
    )


def decode_sources(files: DataFrame) -> DataFrame:
    """``(path, content, md5, mtime)`` of the files that are valid UTF-8.

    The digest is that of the raw bytes; newlines are unified only in the text.
    """
    text = F.col("bytes").cast("string")
    return files.filter(F.is_valid_utf8(text)).select(
        "path",
        normalize_newlines(text).alias("content"),
        F.md5("bytes").alias("md5"),
        "mtime",
    )


def undecodable(files: DataFrame) -> DataFrame:
    return files.filter(~F.is_valid_utf8(F.col("bytes").cast("string"))).select(
        "path", F.lit("not valid UTF-8").alias("reason")
    )


def decode_trees(files: DataFrame) -> DataFrame:
    """``(path, tree)``; ``path`` is the tree file's own path."""
    return decode_sources(files).select("path", F.col("content").alias("tree"))


def _line_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):  # one file after another, so that memory is bounded by the largest
            part = batch.slice(at, 1)
            content, offsets = part["content"][0], None
            if content.is_valid:
                data = np.frombuffer(content.as_buffer(), np.uint8)
                starts = np.r_[0, np.flatnonzero(data == 10) + 1]
                offsets = (starts if starts[-1] == len(data) else np.r_[starts, len(data)]).astype(np.int32)
            column = pa.array([offsets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, "line_starts"])


def with_line_starts(sources: DataFrame) -> DataFrame:
    """``sources`` with ``line_starts``: the byte offsets at which lines of ``content`` start, and its length. An
    empty line after the last newline is none; null content has null. Write the result once (``cut``, a table), and
    snippets are cut out by ranges."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in sources.schema.fields]
    return sources.mapInArrow(_line_starts, ", ".join([*fields, "line_starts array<int>"]))
