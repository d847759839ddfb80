"""Exact top-k inner products by a three-phase uniform threshold.

A vector is cut into ``SLICES`` slices; the score of a row is the sum of the scores its slices have with
those of the query. Each task holds the score lists of its rows, slice by slice.

1. Local lists: each task gives, per query and slice, its best entries and its least score. Sums of what is
   known, least scores standing for what is not, give a lower bound of the k-th best total.
2. Cutoff: what the bound leaves above the least scores, shared evenly among the slices. A row below it in
   every slice cannot be a result. The cutoffs are broadcast, and tasks give the rows that reach
   them in some slice with what they have: a lower and an upper bound. Rows whose upper bound misses the
   better k-th lower bound go.
3. The few rows left are scored exactly.

Equal vectors are one row until the end, with their ``k + 1`` smallest ids, for no more of them
can be results. Queries go in blocks of ``QUERY_BLOCK``, so what is broadcast is bounded. Scores are
integers, held as doubles where those are exact and as 64-bit integers elsewhere.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do vectors whose
scaled squared length exceeds ``LARGEST``, for their scores may not fit 64 bits; shorter
vectors count as padded with zeros; repeated rows of one id and vector count once; a query's own id is
never its result; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snippetlake.session import cut

SLICES = 4
QUERY_BLOCK = 2048
#: Scaled squared length of vectors that take part. By Cauchy and Schwarz no product exceeds it, and the
#: differences and sums of bounds below stay within 64 bits.
LARGEST = 2.0**58
#: Queries scored at once inside a task.
TILE = 256


def _whole_numbers(dims: int, k: int, scale: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes, bounds = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            table = np.zeros((batch.num_rows, dims), np.int64)
            table[np.repeat(np.arange(batch.num_rows), sizes), np.arange(len(values)) - np.repeat(bounds[:-1], sizes)] = np.floor(scale * values)
            same: dict[bytes, list[int]] = {}
            for i, row in zip(batch.column(0).to_pylist(), table, strict=True):
                same.setdefault(row.tobytes(), []).append(i)
            yield pa.record_batch(
                {
                    "vector": pa.array(list(same), pa.binary()),
                    "ids": pa.array([sorted(set(x))[: k + 1] for x in same.values()], pa.list_(pa.int64())),
                }
            )

    return work


def _table(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dims)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products as float64 where they fit, else as int64."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1) < 2**52:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a @ b.T


def _tiles(batches: Iterator[pa.RecordBatch], queries: np.ndarray):
    dims = queries.shape[1]
    cuts = np.linspace(0, dims, SLICES + 1).astype(int)
    for batch in batches:
        rows, numbers = _table(batch.column(1), dims), batch.column(0).to_numpy()
        for a in range(0, len(queries), TILE):
            part = queries[a : a + TILE]
            yield a, numbers, [_product(part[:, x:y], rows[:, x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _local_lists(queries: np.ndarray, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, numbers, scores in _tiles(batches, queries):
            for s, score in enumerate(scores):
                n = min(k + 1, score.shape[1])
                best = np.argpartition(-score, n - 1, axis=1)[:, :n]
                q = np.repeat(np.arange(len(score)), n)
                yield pa.record_batch(
                    {
                        "query": pa.array((a + q).astype(np.int32)),
                        "slice": pa.array(np.full(len(q), s, np.int32)),
                        "row": pa.array(numbers[best.ravel()]),
                        "score": pa.array(score[q, best.ravel()].astype(np.int64)),
                        "least": pa.array(np.repeat(score.min(axis=1), n).astype(np.int64)),
                    }
                )

    return work


def _reaching(queries: np.ndarray, least: np.ndarray, cutoff: np.ndarray, k: int):
    """Rows that reach the cutoff in a slice, with the bounds of their totals above the least scores."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = max(np.abs(least).max(initial=0), cutoff.max(initial=0)) >= 2**50
        for a, numbers, scores in _tiles(batches, queries):
            kind = np.int64 if wide or any(x.dtype == np.int64 for x in scores) else np.float64
            edge, floors = cutoff[a : a + TILE, None].astype(kind), least[a : a + TILE].astype(kind)
            lower, missed = np.zeros(scores[0].shape, kind), np.zeros(scores[0].shape, np.int32)
            for s, score in enumerate(scores):
                above = score.astype(kind, copy=False) - floors[:, s, None]
                reach = above >= edge
                lower += np.where(reach, above, 0)
                missed += ~reach
            upper = lower + missed * edge
            n = min(k + 1, lower.shape[1])
            kth = np.partition(lower, lower.shape[1] - n, axis=1)[:, lower.shape[1] - n] if n == k + 1 else np.zeros(len(lower), kind)
            q, i = np.nonzero((missed < SLICES) & (upper >= kth[:, None]))
            yield pa.record_batch(
                {
                    "query": pa.array((a + q).astype(np.int32)),
                    "row": pa.array(numbers[i]),
                    "lower": pa.array(lower[q, i].astype(np.int64)),
                    "upper": pa.array(upper[q, i].astype(np.int64)),
                }
            )

    return work


def _exact(queries: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(0).to_numpy()
            rows = _table(batch.column(1), queries.shape[1])
            score = (rows * queries[q]).sum(1)
            yield pa.record_batch({"query": batch.column(0), "ids": batch.column(2), "score": pa.array(score)})

    return work


def _kth(rows: DataFrame, value: str, k: int) -> dict[int, int]:
    """The (k+1)-th highest ``value`` of each query that has so many: at least k rows other than
    that of the query itself reach it. One number per query of the block comes to the driver."""
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.col(value).desc())))
    return {r[0]: r[1] for r in ranked.where(F.col("n") == k + 1).select("query", value).collect()}


def search(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` for each row that ``is_query``
    holds for, by the inner product of ``floor(scale * component)``; ties go to the smaller id."""
    spark = vectors.sparkSession
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + (x * scale) * (x * scale))
    read = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asked"))
    read = read.where(sound).where(square <= LARGEST)
    dims = read.agg(F.max(F.size("v"))).first()[0] or 0
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not dims:
        return spark.createDataFrame([], schema)
    turned = read.select("id", "v").mapInArrow(_whole_numbers(dims, k, scale), "vector binary, ids array<bigint>")
    merged = turned.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    rows = cut(merged.withColumn("row", F.monotonically_increasing_id()))
    lists = rows.select("row", "vector")
    asked = cut(read.where("asked and id is not null").select("id", "v").distinct())
    blocks = -(-asked.count() // QUERY_BLOCK)
    out = None
    for b in range(blocks):
        # a block is about QUERY_BLOCK rows by hash of the id: bounded, and taken to the driver to be sent out
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        if not part:
            continue
        ids = [r.id for r in part]
        queries = np.zeros((len(part), dims), np.int64)
        for i, r in enumerate(part):
            queries[i, : len(r.v)] = np.floor(scale * np.array(r.v))
        local = cut(lists.mapInArrow(_local_lists(queries, k), "query int, slice int, row bigint, score bigint, least bigint"))
        least = np.zeros((len(part), SLICES), np.int64)
        for r in local.groupBy("query", "slice").agg(F.min("least").alias("least")).collect():
            least[r[0], r[1]] = r.least
        floors = spark.createDataFrame([(q, s, int(least[q, s])) for q in range(len(part)) for s in range(SLICES)], "query int, slice int, floor bigint")
        known = local.join(F.broadcast(floors), ["query", "slice"]).groupBy("query", "row").agg(F.sum(F.col("score") - F.col("floor")).alias("known"))
        kth = _kth(known, "known", k)
        # rounded down: rows that reach it in no slice have less than the bound in all
        cutoff = np.array([max(kth.get(q, 0), 0) // SLICES for q in range(len(part))], np.int64)
        reached = cut(lists.mapInArrow(_reaching(queries, least, cutoff, k), "query int, row bigint, lower bigint, upper bigint"))
        bound = _kth(reached, "lower", k)
        bounds = spark.createDataFrame([(q, bound.get(q)) for q in range(len(part))], "query int, bound bigint")
        left = reached.join(F.broadcast(bounds), "query").where("bound is null or upper >= bound").select("query", "row")
        scored = left.join(rows, "row").select("query", "vector", "ids").mapInArrow(_exact(queries), "query int, ids array<bigint>, score bigint")
        names = spark.createDataFrame(list(enumerate(ids)), "query int, query_id bigint")
        found = scored.join(F.broadcast(names), "query").select("query", "query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id").distinct()
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")).cast("int")
        best = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], schema) if out is None else out
