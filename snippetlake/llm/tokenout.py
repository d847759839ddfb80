"""Token-id output: documents in order of their key, as blocks of an adaptive range coder.

Documents are range-partitioned by key and encoded partition by partition, so the files of partition p
hold the ids that follow those of partition p - 1. ``idcoder`` cuts the ids of a partition into blocks
that are reset and checksummed on their own; a block is one row of the files, beside the list of the
document pieces in it, so any block can be read by any task. The container of the blocks is Parquet,
because executors may reach the shared folder only through Spark.

Defined cases: null text is empty and gives the end id alone; a null key comes first; rows with equal
keys keep an order within the files and come back as separate rows; an empty table gives no blocks.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snippetlake.llm import idcoder
from snippetlake.llm.tokens import encoder, with_end
from snippetlake.session import shared_dir

#: Ids encoded at a time, a full set of lanes; bounds the memory of a writing task.
GROUP = idcoder.BLOCK * idcoder.LANES
#: Texts are tokenized in slices of about so many bytes.
SLICE = 4 << 20
#: Bytes of an Arrow batch between an executor and its workers.
BATCH_BYTES = 16 << 20
SCHEMA = "part int, block int, data binary, doc array<bigint>, row array<bigint>, size array<int>, after array<bigint>, at array<bigint>"


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, a longer text alone. They are
    copies: Arrow's text functions can go wrong on arrays that begin inside another."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        groups = np.cumsum(sizes) // most
        bounds = [0, *(np.flatnonzero(np.diff(groups)) + 1), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b > a:
                yield batch.take(pa.array(np.arange(a, b)))


def small_batches(spark) -> None:
    """Bound Arrow batches by ``BATCH_BYTES`` where the session has no bound of its own: batches of ten thousand
    long rows would be held by the executor and by every worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


class _Writer:
    """Collects documents of one partition and gives out full groups of blocks."""

    def __init__(self, part: int):
        self.part, self.blocks, self.rows = part, 0, 0
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.first_skip = 0, 0  # ids waiting; ids of the first waiting document already written

    def add(self, doc_ids: np.ndarray, flat: np.ndarray, cuts: np.ndarray) -> None:
        self.ids.append(flat)
        self.docs.append((doc_ids, np.diff(cuts)))
        self.held += len(flat)

    def flush(self, all_of_it: bool) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        flat = np.concatenate(self.ids)
        keys = [k for d, _ in self.docs for k in d]
        sizes = np.concatenate([s for _, s in self.docs])
        whole = len(flat) if all_of_it else len(flat) // GROUP * GROUP
        ends = np.cumsum(sizes) - self.first_skip  # in flat; the first document may have begun earlier
        for a in range(0, whole, GROUP):
            b = min(whole, a + GROUP)
            yield self._group(flat[a:b], a, keys, sizes, ends)
        done = int(np.searchsorted(ends, whole, side="right"))
        rest = len(flat) - whole
        self.first_skip = int(sizes[done] - (ends[done] - whole)) if done < len(sizes) else 0
        self.rows += done
        self.ids, self.held = [flat[whole:]], rest
        self.docs = [(keys[done:], sizes[done:])]

    def _group(self, ids: np.ndarray, offset: int, keys: list, sizes: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        blocks = idcoder.encode(ids)
        out = {k: [] for k in ("doc", "row", "size", "after", "at")}
        for i in range(len(blocks)):
            a = offset + i * idcoder.BLOCK
            b = min(a + idcoder.BLOCK, offset + len(ids))
            lo, hi = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b, side="left"))
            stops = np.minimum(ends[lo : hi + 1], b)
            starts = np.concatenate([[a], stops[:-1]])
            out["doc"].append(keys[lo : hi + 1])
            out["row"].append((self.rows + np.arange(lo, hi + 1)).tolist())
            out["size"].append((stops - starts).tolist())
            out["after"].append((ends[lo : hi + 1] - stops).tolist())
            out["at"].append((self.blocks * idcoder.BLOCK + starts - offset).tolist())
        n = len(blocks)
        made = pa.record_batch(
            {
                "part": pa.array([self.part] * n, pa.int32()),
                "block": pa.array(range(self.blocks, self.blocks + n), pa.int32()),
                "data": pa.array(blocks, pa.binary()),
                **{k: pa.array(v, pa.list_(pa.int32() if k == "size" else pa.int64())) for k, v in out.items()},
            }
        )
        self.blocks += n
        return made


def _write_part(path: str, end: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = _Writer(TaskContext.get().partitionId())
        for batch in slices(batches, "text"):
            flat, cuts = with_end(*encoder(path).encode(batch.column(1)), end)
            writer.add(batch.column(0).to_pylist(), flat, cuts)
            if writer.held >= GROUP:
                yield from writer.flush(False)
        yield from writer.flush(True)

    return work


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts, ``end`` after each, into files below ``folder`` in ascending key order."""
    ordered = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text")).repartitionByRange("doc").sortWithinPartitions("doc")
    ordered.mapInArrow(_write_part(tokenizer, end), SCHEMA).write.option("compression", "uncompressed").parquet(folder)


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, idcoder.LANES):
            part = batch.slice(a, idcoder.LANES)
            ids = idcoder.decode(part.column(1).to_pylist())
            rows = {k: part.column(i).flatten() for i, k in ((2, "doc"), (3, "row"), (5, "after"), (6, "at"))}
            sizes = part.column(4)
            cuts = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy())])
            flat = np.concatenate(ids).astype("<u4")
            if cuts[-1] != len(flat):
                raise ValueError("pieces do not fit the ids of their block")
            view, after = memoryview(flat).cast("B"), rows["after"].to_pylist()
            crc = [idcoder.crc_before(zlib.crc32(view[4 * x : 4 * y]), 4 * z) for x, y, z in zip(cuts, cuts[1:], after, strict=False)]
            parts = np.repeat(part.column(0).to_numpy(), np.diff(sizes.offsets.to_numpy()))
            yield pa.record_batch({"part": pa.array(parts, pa.int32()), **rows, "size": sizes.flatten(), "crc": pa.array(crc, pa.int64())})


def read(spark, folder: str) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) of every document in the files, from the decoded ids."""
    blocks = spark.read.schema(SCHEMA).parquet(folder)
    pieces = blocks.select("part", "data", "doc", "row", "size", "after", "at").mapInArrow(
        _read_blocks, "part int, doc bigint, row bigint, after bigint, at bigint, size int, crc bigint"
    )
    whole = pieces.groupBy("part", "row", "doc").agg(F.min("at").alias("at"), F.sum("size").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    # one row per written partition, so its size does not depend on the documents
    last = blocks.select("part", (F.element_at("at", -1) + F.element_at("size", -1)).alias("end")).groupBy("part").agg(F.max("end").alias("n")).collect()
    before, total = {}, 0
    for r in sorted(last):
        before[r.part], total = total, total + r.n
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "part int, before bigint")
    placed = whole.join(F.broadcast(offsets), "part")
    return placed.select("doc", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
