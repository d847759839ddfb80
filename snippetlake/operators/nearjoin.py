"""Exact self-join of points closer than a threshold.

Points go to the cell of their nearest pivot. If ``y`` lives in cell ``i`` and ``x`` in
cell ``h``, the segment between them crosses the plane halfway between the two pivots,
so ``|x - y| < t`` is possible only if ``x`` is nearer than ``t`` to that plane; only
then does ``x`` visit cell ``i``. Visits go to lower cells only, so every pair meets
exactly once. Pivots are a hash sample of the points themselves, and their number is
the one that makes the sample's own join cheapest: data without structure falls back
to plain blocks.

A cell of any size is cut into chunks by id hash, and each pair of chunks is a group of
its own, so no task holds more than two chunks. What a group sends on depends on the
question:

* ``pairs``: every pair below the threshold, for output;
* ``forest``: one edge per point at most, enough to keep connectivity;
* ``nearest``: the best partner of each point.

The last two grow with the points, never with the pairs, however many copies lie close
together.

With ``weighted`` the measure is the Ward height ``sqrt(2ab/(a+b)) * |x - y|`` of
clusters of sizes a and b. It is never below ``|x - y|``, so the same cells serve.

Matrix products, in single precision and along a few main directions first where few pairs are near, only name candidates, with a bound of their
rounding errors; what counts is measured by differences. Heights that agree to ``PLACES`` places are tied, and ties go to the
least ids, so that neither chunks nor cells decide them.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import FloatType, _parse_datatype_string

from .arrays import block_batches, gathered, matrix, packed, unpacked, values

MIN_CHUNK_ROWS = 1024
MAX_CHUNK_ROWS = 65536
CHUNK_BYTES = 32 << 20
#: Chunks of a table beyond which a caller's chunks are too small: a crowded cell ships each row once per chunk.
MOST_CHUNKS = 32
PIVOT_BYTES = 32 << 20
TEST_ROWS = 512
#: Chunks of a cell beyond which cells are split in further rounds.
CROWDED_CHUNKS = 64
_ROW_COST = 1000.0  # shipping one row costs about as much as comparing this many pairs
_PIVOT_COST = 10.0  # and so does measuring it from one pivot, twice, in double precision
_AT_ONCE = 1 << 21
#: Values of chosen pairs that are measured at once, so that they stay in the processor's cache.
MEASURED_AT_ONCE = 1 << 16
#: A block of comparisons is repeated in double precision where more than one pair in so many may be near.
_SPARSE = 16
#: Long vectors are compared along so many of their main directions first, where that leaves one pair in so many; the
#: directions are those of so many rows, and pay from so many comparisons of a group on.
FLAT, FLAT_LEAVES, FLAT_ROWS, FLAT_FROM = 48, 32, 1024, 1 << 22
_SLACK = 1e-9
PLACES = 9

PAIRS_SCHEMA = "a long, b long, distance double"
FOREST_SCHEMA = "u long, v long"
NEAREST_SCHEMA = "id long, partner long, height double, h2 double, leaves boolean"


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0, out=d)


def noise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bound of the rounding errors in each row of ``squared_distances``."""
    top = (b * b).sum(1).max(initial=0.0)
    return (4.0 * (a.shape[1] + 8) * np.finfo("float64").eps * ((a * a).sum(1) + top))[:, None]


def rounded(h2: np.ndarray) -> np.ndarray:
    """Heights by which pairs are ordered."""
    return np.round(np.sqrt(h2), PLACES)


def measured(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of chosen rows by differences, free of cancellation."""
    out = np.empty(len(i))
    step = max(1, MEASURED_AT_ONCE // max(1, x.shape[1]))
    for at in range(0, len(i), step):
        cut = slice(at, at + step)
        diff = x[i[cut]] - y[j[cut]]
        out[cut] = (diff * diff).sum(1)
    return out


def least(h: np.ndarray, slack: np.ndarray, t: float, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells below ``t`` that may hold the least measure of their row or column, or tie with it."""
    bound = (np.sqrt((h + slack).min(axis, keepdims=True)) + 2.0 * 10.0**-PLACES) ** 2
    return np.nonzero((h - slack <= bound) & (h < t * t + slack))


def first_of(owner: np.ndarray, height: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Place of the least ``(height, other)`` of every owner. The two ids of a pair, the lower one
    first, order the pairs of one owner as the other id does."""
    order = np.lexsort((other, height, owner))
    return order[np.r_[True, owner[order][1:] != owner[order][:-1]]] if len(order) else order


def ward_factor(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 2.0 * a * b / (a + b)


def _chunk_of(ids: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    mixed = ids.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % chunks.astype("uint64")).astype("int64")


@dataclass(frozen=True)
class Cells:
    """Pivots, and after counting, the number of chunks of each cell."""

    pivots: np.ndarray
    threshold: float
    home_chunks: np.ndarray | None = None
    visit_chunks: np.ndarray | None = None  # 0 where the visitors fit beside the one home chunk

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cell of each row, and the (row, cell) visits."""
        if len(self.pivots) == 1:
            none = np.zeros(0, "int64")
            return np.zeros(len(x), "int64"), none, none
        home, near = self._near(x)
        near &= np.arange(len(self.pivots))[None, :] < home[:, None]
        row, cell = np.nonzero(near)
        return home, row, cell

    def reached(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells in which a point nearer than the threshold may live, the own one included."""
        return np.nonzero(self._near(x)[1])

    def _near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = squared_distances(x, self.pivots)
        home = d.argmin(1)
        apart = np.sqrt(squared_distances(self.pivots[home], self.pivots))
        return home, d - d[np.arange(len(x)), home][:, None] <= 2.0 * (self.threshold + _SLACK) * apart + _SLACK + 4.0 * noise(x, self.pivots)

    def portions(self, rows: int) -> Iterator[slice]:
        """So many rows that are placed at a time."""
        step = max(1, _AT_ONCE // len(self.pivots))
        for at in range(0, rows, step):
            yield slice(at, min(rows, at + step))


def chunk_rows(points: DataFrame, n: int, asked: int | None = None) -> int:
    """Rows per chunk: few enough to occupy all cores, else as many as memory allows, since a crowded cell ships
    every row once per chunk. Chunks ``asked`` for grow once there would be more than ``MOST_CHUNKS``."""
    first = points.select(F.size("vec")).first()
    dim = max(1, first[0]) if first else 1
    most = min(MAX_CHUNK_ROWS, max(1, CHUNK_BYTES // (8 * dim)))
    if asked:
        return max(asked, min(most, -(-n // MOST_CHUNKS)))
    cores = points.sparkSession.sparkContext.defaultParallelism
    return min(most, max(MIN_CHUNK_ROWS, n // (2 * cores)))


def _sample(points: DataFrame, n: int, dim: int, chunk: int) -> np.ndarray:
    rows = min(TEST_ROWS + max(TEST_ROWS, 4 * -(-n // chunk), 2 * math.isqrt(n)), max(2, PIVOT_BYTES // (8 * dim)))
    head = points.orderBy(F.xxhash64("id"), "id").limit(rows).select("vec").toArrow()
    return matrix(head["vec"])


def apart_rows(x: np.ndarray, gap: float) -> np.ndarray:
    """Rows of ``x`` that are at least ``gap`` from all rows kept before them: pivots closer
    than the threshold would split a crowded place without separating any of it."""
    kept = np.empty_like(x)
    n = 0
    for row in x:
        if n == 0 or squared_distances(row[None], kept[:n]).min() >= gap * gap:
            kept[n] = row
            n += 1
    return kept[:n]


def split_cost(homes: np.ndarray, visits: np.ndarray, chunk: int) -> float:
    """Price of comparing cells with so many rows that live there and that visit."""
    pairs = (homes * homes / 2 + homes * visits).sum()
    shipped = (homes * np.ceil((homes + visits) / chunk) + visits * np.ceil(homes / chunk)).sum()
    return pairs + _ROW_COST * shipped


def choose_cells(points: DataFrame, threshold: float, n: int, chunk: int) -> Cells:
    """Try numbers of pivots on a bounded sample and keep the cheapest."""
    first = points.select(F.size("vec")).first()
    if n <= chunk or first is None:
        return Cells(np.zeros((1, 1)), threshold)
    sample = _sample(points, n, first[0], chunk)
    half = min(TEST_ROWS, len(sample) // 2)
    test, pool = sample[:half], apart_rows(sample[half:], threshold)
    best, best_cost = Cells(sample[:1], threshold), n * n / 2.0 + _ROW_COST * n * (n / chunk)
    p = 2
    while p <= len(pool):
        cells = Cells(pool[:p], threshold)
        home, row, cell = cells.place(test)
        h = np.bincount(home, minlength=p) / len(test) * n
        v = np.bincount(cell, minlength=p) / len(test) * n
        cost = split_cost(h, v, chunk) + _PIVOT_COST * n * p
        if cost < best_cost:
            best, best_cost = cells, cost
        p *= 2
    return best


def _count_cells(points: DataFrame, cells: Cells, chunk: int) -> Cells:
    p = len(cells.pivots)
    if p == 1:
        homes, visits = np.array([points.count()]), np.zeros(1, "int64")
    else:
        shared = points.sparkSession.sparkContext.broadcast(cells)

        def count(batches):
            c = shared.value
            total = np.zeros((2, p), "int64")
            for batch in batches:
                x = matrix(batch.column(0))
                for part in c.portions(len(x)):
                    home, _, cell = c.place(x[part])
                    total += np.array([np.bincount(home, minlength=p), np.bincount(cell, minlength=p)])
            yield pa.RecordBatch.from_pydict({"cell": np.arange(p), "homes": total[0], "visits": total[1]})

        counted = points.select("vec").mapInArrow(count, "cell long, homes long, visits long")
        rows = counted.groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits")).toArrow()
        homes, visits = np.zeros(p, "int64"), np.zeros(p, "int64")
        homes[rows["cell"].to_numpy()] = rows["homes"].to_numpy()
        visits[rows["cell"].to_numpy()] = rows["visits"].to_numpy()
    home_chunks = np.maximum(1, -(-homes // chunk))
    visit_chunks = -(-visits // chunk)
    visit_chunks[(home_chunks == 1) & (visits <= chunk)] = 0
    return Cells(cells.pivots, cells.threshold, home_chunks, visit_chunks)


def _copies(c: Cells, ids: np.ndarray, home: np.ndarray, row: np.ndarray, cell: np.ndarray):
    """(source row, cell, left chunk, right chunk, role) of every copy to ship. Role 0 is
    the left side of a group, role 1 the right side."""
    nh, nv = c.home_chunks[home], c.visit_chunks[home]
    a = _chunk_of(ids, nh)
    reps = nh + nv
    src = np.repeat(np.arange(len(ids)), reps)
    j = np.arange(len(src)) - np.repeat(np.cumsum(reps) - reps, reps)
    mine, among_homes = a[src], j < nh[src]
    yield (
        src,
        home[src],
        np.where(among_homes, np.minimum(mine, j), mine),
        np.where(among_homes, np.maximum(mine, j), j),
        (among_homes & (j < mine)).astype("int32"),
    )
    if len(row):
        nh, nv = c.home_chunks[cell], c.visit_chunks[cell]
        right = np.where(nv > 0, nh + _chunk_of(ids[row], np.maximum(nv, 1)), 0)
        src = np.repeat(np.arange(len(row)), nh)
        left = np.arange(len(src)) - np.repeat(np.cumsum(nh) - nh, nh)
        yield row[src], cell[src], left, right[src], np.ones(len(src), "int32")


def _place_copies(points: DataFrame, cells: Cells) -> DataFrame:
    """Blocks ``(cell, l, r, role, n, body)`` of the rows of a group: a row of its own for every vector would cost
    more than comparing it."""
    numbers = ["id", "weight"] + (["grp"] if "grp" in points.columns else [])
    shared = points.sparkSession.sparkContext.broadcast(cells)
    schema = "cell long, l long, r long, role int, n int, body binary"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def place(batches):
        c = shared.value
        for rows in gathered(batches, "vec"):
            columns, x = [rows[name].to_numpy() for name in numbers], values(rows["vec"])
            for part in c.portions(len(x)):
                ids, home, row, cell = columns[0][part], *c.place(x[part].astype("float64"))
                copies = [np.concatenate(v) for v in zip(*_copies(c, ids, home, row, cell))]
                yield from block_batches(packed([*copies[1:]], copies[0] + part.start, columns, x), arrow)

    return points.select("id", "weight", "vec", *numbers[2:]).mapInArrow(place, schema)


class _Side:
    def __init__(self, t: pa.Table, dtype: str = "", grouped: bool = False):
        """Rows ``(id, weight, vec)``, or blocks of them whose vectors are of ``dtype``."""
        if dtype:
            numbers, x = unpacked(t["n"], t["body"], 3 if grouped else 2, dtype)
        else:
            numbers, x = [t["id"].to_numpy(), t["weight"].to_numpy()], matrix(t["vec"]) if t.num_rows else np.zeros((0, 1))
        order = np.argsort(numbers[0], kind="stable")
        self.ids = numbers[0][order]
        self.w = numbers[1][order].astype("float64")
        self.x = x[order].astype("float64")
        self.grp = numbers[2][order] if grouped else None
        self.square = (self.x * self.x).sum(1)
        self.made: dict[int, tuple] = {}
        self.flat: _Side | None = None

    def slack(self, other: _Side) -> np.ndarray:
        """Bound of the rounding errors of single-precision products with rows of ``other``, for each row."""
        top = other.square.max(initial=0.0)
        return (4.0 * (self.x.shape[1] + 8) * np.finfo("float32").eps * (self.square + top) + 1e-30)[:, None]

    def single(self, which: int, other: _Side) -> np.ndarray:
        if id(other) not in self.made:
            self.made[id(other)] = _augmented(self.x, self.slack(other))
        return self.made[id(other)][which]

    def flatten(self, centre: np.ndarray, directions: np.ndarray) -> None:
        """Keep the rows' shares along ``directions`` too; rows are never farther apart there."""
        self.flat = copy.copy(self)
        self.flat.x, self.flat.made = (self.x - centre) @ directions, {}
        self.flat.square = (self.flat.x * self.flat.x).sum(1)


def _flatten(left: _Side, right: _Side, t: float) -> None:
    """Keep shares along the main directions of both sides, where these alone tell most pairs apart."""
    n, dim = len(left.ids), left.x.shape[1]
    if dim < 2 * FLAT or n * max(n, len(right.ids)) < FLAT_FROM:
        return
    x = np.vstack([side.x[:: -(-len(side.ids) // FLAT_ROWS)] for side in (left, right) if len(side.ids)])
    centre = x.mean(0)
    x = x - centre
    if not np.isfinite(x).all():
        return
    directions = np.linalg.eigh(x.T @ x)[1][:, -FLAT:]
    x = x @ directions
    test = x[:: -(-len(x) // TEST_ROWS)]
    if (squared_distances(test, x) < t * t).sum() * FLAT_LEAVES > len(test) * len(x):
        return
    for side in (left, right):
        if len(side.ids):
            side.flatten(centre, directions)


def _augmented(x: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single-precision rows ``(u, v)``: ``u[i] @ v[j]`` is the squared distance of rows less the slack of row ``i``."""
    square, one = (x * x).sum(1)[:, None], np.ones((len(x), 1))
    with np.errstate(over="ignore"):
        return np.hstack([-2.0 * x, one, square - slack]).astype("float32"), np.hstack([x, square, one]).astype("float32")


def _near_pairs(left: _Side, at: int, stop: int, side: _Side, first: int, t: float) -> tuple[np.ndarray, ...]:
    """(i, j, squared distance, bound of its error) of rows ``at`` to ``stop`` of left and rows from ``first`` of side
    that may be below ``t``. What single precision cannot tell, such as overflow, may be."""
    with np.errstate(over="ignore", invalid="ignore"):
        if left.flat:
            i, j, _ = _products(left.flat, at, stop, side.flat, first, t)
        if not left.flat or len(i) * _SPARSE > (stop - at) * (len(side.ids) - first):
            i, j, d = _products(left, at, stop, side, first, t)
        else:
            d = np.empty(len(i), "float32")
            u, v = left.single(0, side), side.single(1, left)
            step = max(1, MEASURED_AT_ONCE // u.shape[1])
            for a in range(0, len(i), step):
                cut = slice(a, a + step)
                d[cut] = np.einsum("ij,ij->i", u[at + i[cut]], v[first + j[cut]])
            keep = ~(d >= t * t)
            i, j, d = i[keep], j[keep], d[keep]
    if len(i) * _SPARSE <= (stop - at) * (len(side.ids) - first):
        slack = left.slack(side)[at:stop][i, 0]
        near = d.astype("float64") + slack
        sure = np.isfinite(near)
        return at + i, first + j, np.where(sure, np.maximum(near, 0.0), 0.0), np.where(sure, slack, np.inf)
    x, y = left.x[at:stop], side.x[first:]
    d, slack = squared_distances(x, y), noise(x, y)
    i, j = np.nonzero(d < t * t + slack)
    return at + i, first + j, d[i, j], slack[i, 0]


def _products(left: _Side, at: int, stop: int, side: _Side, first: int, t: float) -> tuple[np.ndarray, ...]:
    """(i, j, squared distance less its bound) of rows counted from ``at`` and ``first``, as single precision has them."""
    d = left.single(0, side)[at:stop] @ side.single(1, left)[first:].T
    near = np.flatnonzero(~(d >= t * t))
    i, j = np.divmod(near, max(1, d.shape[1]))
    return i, j, d.ravel()[near]


def _candidates(left: _Side, right: _Side, within: bool, weighted: bool, t: float):
    """Yield (rows of left, side, rows of side, squared measure, bound of its error) of the group's comparisons
    that may be below ``t``. The Ward height is never below the distance, which is looked at first."""
    step = max(1, _AT_ONCE // max(1, len(left.ids), len(right.ids)))
    if len(left.ids):
        _flatten(left, right, t)
    for at in range(0, len(left.ids), step):
        for side in ([left] if within else []) + ([right] if len(right.ids) else []):
            i, j, h, slack = _near_pairs(left, at, min(at + step, len(left.ids)), side, at if side is left else 0, t)
            if weighted:
                factor = ward_factor(left.w[i], side.w[j])
                h, slack = h * factor, slack * factor
            keep = h < t * t + slack
            if side is left:
                keep &= j > i
            if left.grp is not None:
                keep &= left.grp[i] != side.grp[j]
            yield i[keep], side, j[keep], h[keep], slack[keep]


def _measure(left: _Side, i: np.ndarray, side: _Side, j: np.ndarray, weighted: bool) -> np.ndarray:
    """Squared measure of chosen pairs."""
    out = measured(left.x, side.x, i, j)
    return out * ward_factor(left.w[i], side.w[j]) if weighted else out


def _pairs(left, right, within, weighted, t) -> pa.Table:
    found = []
    for i, side, j, _, _ in _candidates(left, right, within, weighted, t):
        d = np.sqrt(_measure(left, i, side, j, weighted))
        keep = d < t
        a, b = left.ids[i[keep]], side.ids[j[keep]]
        found.append((np.minimum(a, b), np.maximum(a, b), d[keep]))
    cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, "int64")] * 2 + [np.zeros(0)]
    return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "distance": pa.array(cols[2], pa.float64())})


def _union(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Fold edges into a labelling in which every label is its group's least member."""
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def _forest(left, right, within, weighted, t) -> pa.Table:
    ids = np.unique(np.concatenate([left.ids, right.ids]))
    at_left, at_right = np.searchsorted(ids, left.ids), np.searchsorted(ids, right.ids)
    label = np.arange(len(ids))
    for i, side, j, h, slack in _candidates(left, right, within, weighted, t):
        own, other = at_left[i], (at_left if side is left else at_right)[j]
        unsure = h >= t * t - slack
        label = _union(label, own[~unsure], other[~unsure])
        # pairs that are together already need no measuring
        unsure = np.flatnonzero(unsure & (label[own] != label[other]))
        near = unsure[_measure(left, i[unsure], side, j[unsure], weighted) < t * t]
        label = _union(label, own[near], other[near])
    child = np.nonzero(label != np.arange(len(ids)))[0]
    return pa.table({"u": pa.array(ids[child], pa.int64()), "v": pa.array(ids[label[child]], pa.int64())})


class _Best:
    """Best partner per row of one side: least rounded height, then least id."""

    def __init__(self, side: _Side):
        self.side = side
        self.height = np.full(len(side.ids), np.inf)
        self.h2 = np.full(len(side.ids), np.inf)
        self.partner = np.zeros(len(side.ids), "int64")
        self.leaf = np.zeros(len(side.ids), bool)

    def offer(self, mine: np.ndarray, h2: np.ndarray, other: _Side, theirs: np.ndarray) -> None:
        height, ids = rounded(h2), other.ids[theirs]
        one = first_of(mine, height, ids)
        mine, height, h2, ids, theirs = mine[one], height[one], h2[one], ids[one], theirs[one]
        better = (height < self.height[mine]) | ((height == self.height[mine]) & (ids < self.partner[mine]))
        m = mine[better]
        self.height[m], self.h2[m], self.partner[m] = height[better], h2[better], ids[better]
        self.leaf[m] = (self.side.w[m] == 1) & (other.w[theirs[better]] == 1)


def _nearest(left, right, within, weighted, t) -> pa.Table:
    best = {id(left): _Best(left), id(right): _Best(right)}
    for i, side, j, h, slack in _candidates(left, right, within, weighted, t):
        for owner, mine, other, theirs in ((left, i, side, j), (side, j, left, i)):
            # those that may hold the least measure of their row, or tie with it
            top = np.full(len(owner.ids), np.inf)
            np.minimum.at(top, mine, h + slack)
            own = np.flatnonzero(h - slack <= (np.sqrt(np.minimum(top, best[id(owner)].h2)[mine]) + 2.0 * 10.0**-PLACES) ** 2)
            a, b = mine[own], theirs[own]
            h2 = _measure(left, i[own], side, j[own], weighted)
            ok = h2 < t * t
            best[id(owner)].offer(a[ok], h2[ok], other, b[ok])
    parts = []
    for b in best.values():
        hit = b.h2 < t * t
        parts.append((b.side.ids[hit], b.partner[hit], b.height[hit], b.h2[hit], b.leaf[hit]))
    ids, partner, height, h2, leaf = (np.concatenate(c) for c in zip(*parts))
    return pa.table({"id": pa.array(ids, pa.int64()), "partner": pa.array(partner, pa.int64()), "height": pa.array(height, pa.float64()), "h2": pa.array(h2, pa.float64()), "leaves": pa.array(leaf, pa.bool_())})


_MODES = {"pairs": (_pairs, PAIRS_SCHEMA), "forest": (_forest, FOREST_SCHEMA), "nearest": (_nearest, NEAREST_SCHEMA)}


def compared(copies: DataFrame, threshold: float, mode: str, weighted: bool, dtype: str = "", grouped: bool = False) -> DataFrame:
    """Work off ``copies (cell, l, r, role, id, weight, vec)``, or blocks of them whose vectors are of ``dtype``, one group
    per pair of chunks."""
    work, schema = _MODES[mode]

    def group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy()
        left, right = (_Side(table.filter(pa.array(role == r)), dtype, grouped) for r in (0, 1))
        within = key[1].as_py() == key[2].as_py()
        return work(left, right, within, weighted, threshold)

    return copies.groupBy("cell", "l", "r").applyInArrow(group, schema)


def near_join(points: DataFrame, threshold: float, mode: str = "pairs", weighted: bool = False, chunk: int | None = None, cells: Cells | None = None) -> DataFrame:
    """Join ``points (id, weight, vec)`` with itself below ``threshold`` (strictly).

    ``points`` is read a few times, so callers hand in a stored table. With a column ``grp``, rows of one group are
    not compared. Where the pivots one driver can hold leave
    cells of more than ``CROWDED_CHUNKS`` chunks, cells are split in further rounds (``pivottree``).
    """
    n = points.count()
    chunk = chunk_rows(points, n, chunk)
    placed = _count_cells(points, cells or choose_cells(points, threshold, n, chunk), chunk)
    if cells is None and "grp" not in points.columns and len(placed.pivots) > 1 and placed.home_chunks.max() > CROWDED_CHUNKS:
        from .pivottree import near_join_tree

        return near_join_tree(points, threshold, mode, weighted, chunk)
    dtype = "float32" if points.schema["vec"].dataType.elementType == FloatType() else "float64"
    return compared(_place_copies(points, placed), threshold, mode, weighted, dtype, "grp" in points.columns)
