"""Packing by cutting-stock column generation.

Documents become token pieces: whole sequences of ``size`` ids, and one shorter rest. The histogram of
rest lengths, in steps of ``STEP`` ids, has at most ``size / STEP`` rows whatever the input; a linear
program over patterns (which lengths share a sequence) is solved on it to its end, new patterns being priced by a
knapsack dynamic program. The solution's full patterns are rounded down, what is left over is packed
largest first into further patterns, and pieces take the slots of their length in rank order, numbered
in pieces of each class, so a length that a third of all documents share is no single task.

Defined cases: null text is empty and gives the end id alone; a repeated document is packed again; an
empty table gives no rows; further columns are not read. Only the last few sequences, those of the
left-over, can be far from full: a bounded number for any input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snippetlake.llm.tokenout import slices
from snippetlake.llm.tokens import encoder, with_end
from snippetlake.session import cut

SIZE = 2048
#: Lengths are told apart in steps of so many ids: more classes, less padding, a longer program.
STEP = 4
#: Counts are raised by up to this share of a piece, each class by another, so that no basis is degenerate and
#: every round of the program gains; rounding takes it back.
TILT = 1e-7
#: Columns of the program that leave more room than this, in steps, are not rounded.
SLACK = 0
#: Stretches a class is ranked in, at most; their totals are what is broadcast.
STRETCHES = 512
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _cut_documents(path: str, end: int, size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, cuts = with_end(*encoder(path).encode(batch.column(1)), end)
            view, total = memoryview(flat.astype("<u4")).cast("B"), np.diff(cuts)
            n = -(-total // size)
            first = np.concatenate([[0], np.cumsum(n)])
            start = (np.arange(first[-1]) - np.repeat(first[:-1], n)) * size
            length = np.minimum(size, np.repeat(total, n) - start)
            at = np.repeat(cuts[:-1], n) + start
            crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array(np.repeat(total, n)),
                }
            )

    return work


def pieces(docs: DataFrame, tokenizer: str, end: int = 1, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of every document: full ones of ``size`` ids, then the rest."""
    read = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(_cut_documents(tokenizer, end, size), PIECE)


def _knapsack(value: np.ndarray, weight: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of items within ``room``: its value and counts."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    least = int(weight[0])  # ascending
    for w in range(least, room + 1):
        k = int(np.searchsorted(weight, w, side="right"))
        got = value[:k] + best[w - weight[:k]]
        i = int(got.argmax())
        if got[i] > best[w - 1] + 1e-12:
            best[w], pick[w] = got[i], i
        else:
            best[w] = best[w - 1]
    counts, w = np.zeros(len(value), np.int64), room
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            counts[pick[w]] += 1
            w -= int(weight[pick[w]])
    return float(best[room]), counts


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: pieces}, copies) that take exactly the pieces of ``histogram``.

    Class c needs c units of a sequence's ``room``. Revised simplex until no column pays; columns are
    those of the largest-first packing while they pay, then priced by the knapsack.
    """
    weight = np.array(sorted(c for c, n in histogram.items() if n), np.int64)
    if not len(weight):
        return []
    demand = np.array([histogram[int(c)] for c in weight], float)
    columns = np.diag(room // weight).astype(float)
    tilted = demand + TILT * (1 + np.random.default_rng(0).permutation(len(weight))) / len(weight)
    inverse, x = np.diag(1 / np.diag(columns)), tilted / np.diag(columns)
    greedy = _decreasing(demand.astype(np.int64), weight, room)
    seeds = np.array([[p.get(int(c), 0) for c in weight] for p, _ in greedy], float)
    while True:
        prices = inverse.sum(0)
        seeded = (seeds * prices).sum(1)
        value, counts = float(seeded.max()), seeds[int(seeded.argmax())]
        if value <= 1 + 1e-7:
            value, counts = _knapsack(prices, weight, room)
        if value <= 1 + 1e-7:
            break
        way = (inverse * counts).sum(1)
        able = way > 1e-9
        ratio = np.where(able, x / np.where(able, way, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * way, 0)
        x[out] = ratio[out]
        columns[:, out] = counts
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
    patterns, left = [], demand.astype(np.int64)
    for i in np.argsort(-x, kind="stable"):
        column = columns[:, i].astype(np.int64)
        used = column > 0
        copies = min(int(x[i] + 1e-6), int((left[used] // column[used]).min()))
        if copies > 0 and room - int(weight @ column) <= SLACK:
            left = left - copies * column
            patterns.append(({int(weight[k]): int(column[k]) for k in np.flatnonzero(used)}, copies))
    return patterns + _decreasing(left, weight, room)


def _decreasing(left: np.ndarray, weight: np.ndarray, room: int) -> list[tuple[dict[int, int], int]]:
    """Largest first into what room there is, each pattern as often as the counts allow: at least
    one class has too few pieces left after each, so the steps do not grow with the counts."""
    left, patterns = left.copy(), []
    while left.any():
        column, free = np.zeros_like(left), room
        while True:
            fit = np.flatnonzero((weight <= free) & (left > column))
            if not len(fit):
                break
            k = int(fit[-1])
            n = min(free // int(weight[k]), int(left[k] - column[k]))
            column[k] += n
            free -= n * int(weight[k])
        used = column > 0
        copies = int((left[used] // column[used]).min())
        left -= copies * column
        patterns.append(({int(weight[k]): int(column[k]) for k in np.flatnonzero(used)}, copies))
    return patterns


def pack(parts: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """``parts`` (columns of ``PIECE``) with ``sequence_id`` and ``offset``: a sequence holds at most
    ``size`` ids, its pieces lie side by side from 0."""
    spark = parts.sparkSession
    kept = cut(parts.withColumn("class", F.ceil(F.col("length") / step).cast("int")))
    histogram = {r["class"]: r["n"] for r in kept.groupBy("class").agg(F.count("*").alias("n")).collect()}
    slots, taken, sequence = [], {}, 0
    for classes, copies in plan(histogram, size // step):
        for c, per in classes.items():
            low = taken.get(c, 0)
            slots.append((c, low, low + per * copies, sequence, per))
            taken[c] = low + per * copies
        sequence += copies
    table = spark.createDataFrame(slots, "slot_class int, low bigint, high bigint, first bigint, per bigint")
    stretches = min(STRETCHES, sum(histogram.values()) // 20_000 + 1)
    order = ["doc_id", "start", "length", "ids_crc32"]
    spot = kept.withColumn("stretch", F.pmod(F.xxhash64(*order), F.lit(stretches)).cast("int"))
    counts = spot.groupBy("class", "stretch").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("class", "stretch", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("class", "stretch").orderBy(*order)) - 1
    ranked = spot.withColumn("local", local).join(F.broadcast(offsets), ["class", "stretch"]).withColumn("rank", F.col("before") + F.col("local"))
    fits = (F.col("class") == F.col("slot_class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(F.broadcast(table), fits).withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("per")))
    along = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), *order, "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*[c for c in kept.columns if c != "class"], "sequence_id", F.coalesce(F.sum("length").over(along), F.lit(0)).alias("offset"))
