"""Exact top-k for many queries, by cells with bounds.

Vectors are kept in cells around pivots from a bounded sample; a cell knows its centre, its radius and its largest
norm, which bound the inner product of a query with anything in it. Queries visit cells by falling bound, a few in
the first round and more in each later one, until the next bound cannot reach the query's k-th score. A round ships
queries to the cells they visit, and vectors of those cells only; a crowded cell is cut into chunks and a crowded
visit into blocks, so no group holds more than ``BLOCK_ROWS`` vectors and ``_block_rows`` queries. Without structure every cell is visited and the
result is still exact.

Defined cases: no vectors or no queries give no hits; ties go to the lower ``vector_id``, as in ``search``; vectors
need not be unit vectors.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import cut
from . import search
from .arrays import block_batches, gathered, matrix, packed, unpacked, values
from .nearjoin import squared_distances

#: Cells at most, and bytes of their centres.
MAX_CELLS, CELL_BYTES = 4096, 32 << 20
#: Cells that a query visits in the first round, and how many times more in each later one.
FIRST_CELLS, GROWTH = 2, 4
#: Queries of a group: so many times the vectors at most, as far as they fit so many bytes. Vectors are shipped once for
#: every block of queries, so larger blocks ship fewer.
QUERY_TIMES, QUERY_BYTES = 4, 64 << 20
#: Bytes of vectors, in single precision, on a shelf, and of queries that meet them.
SHELF_BYTES = 16 << 20
#: Queries and vectors whose products are in memory at once.
ASKED_AT_ONCE, VECTORS_AT_ONCE = 4096, 512
#: Groups for each core at least, of queries that are dealt so many at a time.
GROUPS_PER_CORE, TURN_ROWS = 4, 256
_AT_ONCE = 1 << 22
_FOUND = T.StructType([T.StructField(n, t) for n, t in (("query_id", T.LongType()), ("rank_key", T.DoubleType()), ("score", T.DoubleType()), ("vector_id", T.LongType()), ("_row", T.LongType()))])
#: Slack of bounds, above the noise of sums and the rounding of scores.
_SLACK = 1e-8


@dataclass(frozen=True)
class CellIndex:
    """``placed``: the vectors with their ``cell``; the rest has one entry per cell."""

    placed: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    rows: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with each cell."""
        own = (q * q).sum(1)[:, None]
        away = np.sqrt(squared_distances(q, self.centres))
        by_norm = q @ self.centres.T + np.sqrt(own) * self.radius
        by_distance = (own + self.norm**2 - np.maximum(away - self.radius, 0.0) ** 2) / 2.0
        return np.where(self.rows > 0, np.minimum(by_norm, by_distance) + _SLACK, -np.inf)


@dataclass
class Work:
    """What a search has done: pairs scored, of how many, and rounds."""

    scored: int = 0
    pairs: int = 0
    rounds: list[int] = field(default_factory=list)


def build_cells(vectors: DataFrame, cells: int | None = None) -> CellIndex:
    """Place ``vectors (vector_id, embedding, …)`` in cells and write them down."""
    n = vectors.count()
    first = vectors.select(F.size("embedding")).first()
    dim = max(1, first[0]) if first else 1
    most = min(MAX_CELLS, max(1, CELL_BYTES // (8 * dim)))
    # a table of one chunk is scored at once sooner than in rounds
    wanted = max(1, min(most, cells or (1 if n <= search.BLOCK_ROWS else 2 * math.isqrt(n))))
    head = vectors.select("vector_id", "embedding").orderBy(F.xxhash64("vector_id"), "vector_id").limit(wanted).toArrow()
    pivots = np.unique(matrix(head["embedding"]), axis=0) if head.num_rows else np.zeros((1, 1))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType()), T.StructField("norm", T.DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        step = max(1, _AT_ONCE // len(c))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = pa.Table.from_batches([batch.slice(at, step)])
                x = matrix(rows["embedding"])
                home = squared_distances(x, c).argmin(1)
                away = np.sqrt(((x - c[home]) ** 2).sum(1))
                out = rows.append_column("cell", pa.array(home.astype("int32"))).append_column("away", pa.array(away)).append_column("norm", pa.array(np.sqrt((x * x).sum(1))))
                yield from out.to_batches()

    placed = cut(vectors.mapInArrow(place, schema))
    summary = placed.groupBy("cell").agg(F.max("away").alias("away"), F.max("norm").alias("norm"), F.count("*").alias("n")).toArrow()
    radius, norm, rows = np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots), "int64")
    at = summary["cell"].to_numpy()
    radius[at], norm[at], rows[at] = (summary[c].to_numpy() for c in ("away", "norm", "n"))
    return CellIndex(placed.drop("away", "norm"), pivots, radius, norm, rows)


@dataclass(frozen=True)
class Shelves:
    """Neighbouring cells put together as far as a task holds them: a query is shipped once for a shelf, however many of
    its cells it visits. A crowded cell takes several shelves. ``first`` and ``parts`` are the shelves of a cell,
    ``place`` is its place among the cells of its shelf."""

    first: np.ndarray
    parts: np.ndarray
    place: np.ndarray

    @property
    def words(self) -> int:
        """Whole numbers that hold a bit for each cell of a shelf."""
        return int(self.place.max(initial=0)) // 62 + 1


def make_shelves(centres: np.ndarray, rows: np.ndarray, most: int) -> Shelves:
    """Shelves of at most ``most`` rows, along a path from centre to nearest centre."""
    n = len(centres)
    first, parts, place = np.zeros(n, "int64"), np.maximum(1, -(-rows // most)), np.zeros(n, "int64")
    left, at, shelf, held, count = np.ones(n, bool), 0, 0, 0, 0
    for _ in range(n):
        left[at] = False
        if count and held + rows[at] > most:
            shelf, held, count = shelf + 1, 0, 0
        first[at], place[at] = shelf, count
        held, count = held + rows[at], count + 1
        if parts[at] > 1:
            shelf, held, count = shelf + int(parts[at]), 0, 0
        if left.any():
            away = np.where(left, squared_distances(centres[at : at + 1], centres)[0], np.inf)
            at = int(away.argmin())
    return Shelves(first, parts, place)


def top_k_cells(index: CellIndex, queries: DataFrame, k: int = search.DEFAULT_K, work: Work | None = None) -> DataFrame:
    """``(query_id, rank, score, vector_id, …)`` as ``search.top_k``, over the cells of ``index``."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark, work = queries.sparkSession, work if work is not None else Work()
    payload = [c for c in index.placed.columns if c not in ("embedding", "cell")]
    asked = cut(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("vec")))
    work.pairs = asked.count() * int(index.rows.sum())
    dim = max(1, index.centres.shape[1])
    shelves = make_shelves(index.centres, index.rows, max(search.BLOCK_ROWS, SHELF_BYTES // (4 * dim)))
    # rows have numbers of their own, by which what else they hold is looked up in the end
    numbered = cut(index.placed.withColumn("_row", F.monotonically_increasing_id()))
    best, visited, some = spark.createDataFrame([], _FOUND), 0, FIRST_CELLS
    while visited < len(index.centres) and index.rows.any():
        floor = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank_key").alias("kth")).filter(F.col("n") == k).select("query_id", "kth")
        # chosen twice, once to be counted: what a round ships is not written before
        known = cut(asked.join(floor, "query_id", "left"))
        # at most one row per cell or shelf
        crowd = {(r.shelf, r.cell): r.n for r in _chosen(index, shelves, known, visited, some).groupBy("shelf", "cell").agg(F.sum("n").alias("n")).collect()}
        if not crowd:
            break
        work.scored += sum(n * int(index.rows[c]) for (_, c), n in crowd.items() if c >= 0)
        work.rounds.append(sum(n for (_, c), n in crowd.items() if c >= 0))
        calls = {s: n for (s, c), n in crowd.items() if c < 0}
        fresh = _scored(index, shelves, numbered, known, visited, some, calls, k)
        best = cut(_leading(best.unionByName(fresh), k))
        visited, some = visited + some, some * GROWTH if visited == 0 else len(index.centres)
    rest = numbered.drop("embedding", "cell")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank_key"), "vector_id"))
    return best.withColumn("rank", rank).drop("vector_id").join(rest, "_row").select("query_id", "rank", "score", *payload)


def _leading(candidates: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank_key"), "vector_id"))
    return candidates.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


class _Calls:
    """The visits of a portion of queries: for every query and shelf a bit for each cell of the shelf."""

    def __init__(self, cells: CellIndex, shelves: Shelves, vec: np.ndarray, kth: np.ndarray, visited: int, some: int):
        bound = cells.bounds(vec)
        order = np.argsort(-bound, axis=1, kind="stable")[:, visited : visited + some]
        high = np.take_along_axis(bound, order, 1)
        self.row, place = np.nonzero((high >= np.where(np.isnan(kth), -np.inf, kth)[:, None]) & (high > -np.inf))
        self.cell = order[self.row, place]
        times = shelves.parts[self.cell]
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, cell = np.repeat(self.row, times), np.repeat(self.cell, times)
        shelf, at = shelves.first[cell] + part, shelves.place[cell]
        key, self.of = np.unique(row * (int(shelves.first.max()) + int(shelves.parts.max()) + 1) + shelf, return_inverse=True)
        self.query, self.shelf = np.divmod(key, int(shelves.first.max()) + int(shelves.parts.max()) + 1)
        self.bits = np.zeros((shelves.words, len(key)), "int64")
        np.bitwise_or.at(self.bits, (at // 62, self.of), np.int64(1) << (at % 62))


def _calls(batches: Iterator[pa.RecordBatch], cells: CellIndex, shelves: Shelves, visited: int, some: int):
    """(ids, k-th scores, vectors, visits) of portions of ``(query_id, kth, vec)``."""
    step = max(1, _AT_ONCE // len(cells.centres))
    for rows in gathered(batches, "vec"):
        for at in range(0, rows.num_rows, step):
            part = rows.slice(at, step)
            kth, x = part["kth"].to_numpy().astype("float64"), values(part["vec"])
            yield part["query_id"].to_numpy(), kth, x, _Calls(cells, shelves, x.astype("float64"), kth, visited, some)


def _chosen(index: CellIndex, shelves: Shelves, known: DataFrame, visited: int, some: int) -> DataFrame:
    """(shelf, cell, n): visits to each cell (shelf -1), and to each shelf (cell -1)."""
    shared = known.sparkSession.sparkContext.broadcast((CellIndex(None, index.centres, index.radius, index.norm, index.rows), shelves))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_cell, by_shelf = Counter(), Counter()
        for *_, calls in _calls(batches, *shared.value, visited, some):
            for found, counted in ((calls.cell, by_cell), (calls.shelf, by_shelf)):
                counted.update(dict(zip(*(v.tolist() for v in np.unique(found, return_counts=True)))))
        shelf, cell = [-1] * len(by_cell) + [*by_shelf], [*by_cell] + [-1] * len(by_shelf)
        yield pa.record_batch({"shelf": pa.array(shelf, pa.int64()), "cell": pa.array(cell, pa.int64()), "n": pa.array([*by_cell.values(), *by_shelf.values()], pa.int64())})

    return known.select("query_id", "kth", "vec").mapInArrow(count, "shelf long, cell long, n long")


def _block_rows(dim: int) -> int:
    """Queries of one group."""
    return max(search.BLOCK_ROWS, min(QUERY_TIMES * search.BLOCK_ROWS, QUERY_BYTES // (8 * max(1, dim))))


def _scored(index: CellIndex, shelves: Shelves, numbered: DataFrame, known: DataFrame, visited: int, some: int, calls: dict[int, int], k: int) -> DataFrame:
    """The best ``k`` of each visited shelf for each query that visits it. Vectors and queries are shipped in blocks."""
    most = max(_block_rows(index.centres.shape[1]), SHELF_BYTES // (4 * max(1, index.centres.shape[1])))
    spark = known.sparkSession
    # enough groups for all cores, also where everything fits a few
    wanted = GROUPS_PER_CORE * spark.sparkContext.defaultParallelism / sum(calls.values())
    blocks = {s: max(1, -(-n // most), min(-(-n // TURN_ROWS), math.ceil(n * wanted))) for s, n in calls.items()}
    parts = min(1024, 2 * sum(blocks.values()))
    shared = spark.sparkContext.broadcast((CellIndex(None, index.centres, index.radius, index.norm, index.rows), shelves, blocks))
    keys = "shelf long, qb long, n int, body binary"
    arrow = to_arrow_schema(_parse_datatype_string(keys))
    words = shelves.words
    kinds = ["float32" if frame.schema[c].dataType.elementType == T.FloatType() else "float64" for frame, c in ((numbered, "embedding"), (known, "vec"))]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, shelves, blocks = shared.value
        for rows in gathered(batches, "embedding"):
            row, cell, x = rows["_row"].to_numpy(), rows["cell"].to_numpy().astype("int64"), values(rows["embedding"])
            ids = rows["vector_id"].fill_null(np.iinfo("int64").max).to_numpy().astype("int64")
            shelf = shelves.first[cell] + row % shelves.parts[cell]
            times = np.array([blocks.get(s, 0) for s in shelf.tolist()], "int64")
            src = np.repeat(np.arange(len(row)), times)
            qb = np.arange(len(src)) - np.repeat(np.cumsum(times) - times, times)
            yield from block_batches(packed([shelf[src], qb], src, [row, ids, shelves.place[cell]], x), arrow)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, shelves, blocks = shared.value
        for ids, kth, x, calls in _calls(batches, cells, shelves, visited, some):
            if not len(calls.shelf):
                continue
            # neighbours stay together, so blocks are long
            turn = zlib.crc32(ids[:1].tobytes()) + calls.query // TURN_ROWS
            qb = turn % np.array([blocks[s] for s in calls.shelf.tolist()], "int64")
            columns = [ids[calls.query], kth[calls.query].view("int64"), *calls.bits]
            yield from block_batches(packed([calls.shelf, qb], np.arange(len(qb)), columns, x[calls.query]), arrow)

    def pair(v: pa.Table, q: pa.Table) -> pa.Table:
        if v.num_rows == 0 or q.num_rows == 0:
            return to_arrow_schema(_FOUND).empty_table()
        (row, ids, place), x = unpacked(v["n"], v["body"], 3, kinds[0])
        (query, kth, *bits), y = unpacked(q["n"], q["body"], 2 + words, kinds[1])
        return _leaders((row, ids, place, x), (query, kth.view("float64"), bits, y), k)

    left = numbered.select("_row", "vector_id", "cell", "embedding").mapInArrow(send, keys).repartition(parts, "shelf", "qb")
    right = known.select("query_id", "kth", "vec").mapInArrow(ask, keys).repartition(parts, "shelf", "qb")
    return left.groupBy("shelf", "qb").cogroup(right.groupBy("shelf", "qb")).applyInArrow(pair, _FOUND)


def _leaders(vectors: tuple, queries: tuple, k: int) -> pa.Table:
    """The best ``k`` of the vectors of a shelf for each query, out of the cells that it visits."""
    row, ids, place, x = vectors
    query, kth, bits, y = queries
    order = np.argsort(place, kind="stable")
    row, ids, place, x = row[order], ids[order], place[order], x[order]
    starts = np.r_[np.flatnonzero(np.r_[True, place[1:] != place[:-1]]), len(place)].tolist()
    parts = [_leading_of((row, ids, place, x), starts, tuple(c[a : a + ASKED_AT_ONCE] for c in (query, kth, y)), [b[a : a + ASKED_AT_ONCE] for b in bits], k) for a in range(0, len(query), ASKED_AT_ONCE)]
    columns = [np.concatenate(c) for c in zip(*parts)]
    schema = to_arrow_schema(_FOUND)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _leading_of(vectors: tuple, starts: list[int], queries: tuple, bits: list[np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    """As ``_leaders``, of a few queries. Products in single precision, with a bound of their rounding errors, name
    candidates; those are scored anew."""
    row, ids, place, x = vectors
    query, kth, y = queries
    floor = np.where(np.isnan(kth), -np.inf, kth)
    x32, y32 = x.astype("float32"), y.astype("float32")
    longest = np.sqrt(np.einsum("ij,ij->i", x, x, dtype="float64").max(initial=0.0))
    error = 8.0 * (x.shape[1] + 8) * np.finfo("float32").eps * longest * np.sqrt(np.einsum("ij,ij->i", y, y, dtype="float64")) + _SLACK
    held, fresh = [np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0), np.zeros(0)], []

    def settle() -> None:
        nonlocal held, fresh
        held = [np.concatenate(c) for c in zip(held, *fresh)]
        keep = search._best(held[0], held[2], ids[held[1]], k)
        held, fresh = [c[keep] for c in held], []
        counts = np.bincount(held[0], minlength=len(query))
        full = counts == k
        floor[full] = np.maximum(floor[full], held[2][(np.cumsum(counts) - 1)[full]])

    for start, stop in zip(starts[:-1], starts[1:]):
        at = int(place[start])
        who = np.flatnonzero(bits[at // 62] >> (at % 62) & 1)
        for a in range(start, stop, VECTORS_AT_ONCE) if len(who) else ():
            some = slice(a, min(stop, a + VECTORS_AT_ONCE))
            with np.errstate(over="ignore", invalid="ignore"):
                s = (y32 if len(who) == len(y32) else y32[who]) @ x32[some].T
                least = floor[who] - error[who]
                if s.shape[1] > k and (least == -np.inf).any():
                    kth_here = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k].astype("float64")
                    least = np.fmax(least, kth_here - 2.0 * error[who])
                near = np.flatnonzero(~(s < least[:, None]))
            i, j = np.divmod(near, s.shape[1])
            i, j = who[i], a + j
            score = np.empty(len(i))
            for b in range(0, len(i), 1024):
                score[b : b + 1024] = np.einsum("ij,ij->i", y[i[b : b + 1024]], x[j[b : b + 1024]], dtype="float64")
            key = np.round(score, search.SCORE_DECIMALS)
            keep = key >= floor[i]
            fresh.append([i[keep], j[keep], key[keep], score[keep]])
            if sum(len(f[0]) for f in fresh) > k * len(query):
                settle()
    settle()
    return query[held[0]], held[2], held[3], ids[held[1]], row[held[1]]
