"""Near join whose crowded cells are split again by pivots of their own, round after round.

A round draws a sample of every cell that holds more than a chunk, chooses pivots from it inside tasks, and
sends the cell's rows to the cells below. Rows that live in a cell (role 0) go to their nearest pivot and visit
lower siblings as in the flat join. Visitors (role 1) go to every cell below in which a point nearer than the
threshold may live, since those they look for live in one of them each. So every pair still meets once.

Pivots are a table, joined to salted parts of their cell, and never pass the driver; a part holds about one
chunk. A cell is split only where its sample says that this is cheaper than comparing its chunks; what stays
crowded in the end is cut into chunks. Cells are numbered like a heap: those below ``c`` are
``c * fan_out + 1`` and on.

Defined cases: no points give no pairs; points without a partner give none; equal points are never parted by
pivots and meet in chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .arrays import matrix
from .nearjoin import Cells, apart_rows, chunk_rows, compared, split_cost

FAN_OUT = 64
#: Levels at most, so that numbers of cells fit 64 bits.
MAX_LEVELS = 9
#: Rows a crowded cell is judged by, half of them to choose pivots and half to price them.
SAMPLE_ROWS = 1024
_PIECES = 1 << 30


def _sizes(rows: DataFrame) -> DataFrame:
    """Rows that live in and that visit each cell; where none lives there is nothing to compare."""
    homes, visits = F.sum(1 - F.col("role")).alias("homes"), F.sum("role").alias("visits")
    return rows.groupBy("cell").agg(homes, visits).where("homes > 0")


def _pivots(rows: DataFrame, large: DataFrame, level: int, threshold: float, chunk: int, fan_out: int, always: bool) -> DataFrame:
    """(cell, pivots) of the cells that are worth splitting."""
    vec = rows.schema["vec"].dataType.simpleString()
    part = F.pmod(F.xxhash64(F.lit(level), "id"), F.lit(_PIECES)) / float(_PIECES)
    drawn = rows.where("role = 0").join(large, "cell").where(part * F.col("homes") < SAMPLE_ROWS)

    def choose(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = matrix(table["vec"])[np.argsort(table["id"].to_numpy(), kind="stable")]
        x = x[np.random.default_rng(0).permutation(len(x))]
        homes, visits = (table[c][0].as_py() for c in ("homes", "visits"))
        test, pool = x[: len(x) // 2], apart_rows(x[len(x) // 2 :], threshold)[:fan_out]
        best, best_cost = None, np.inf if always else split_cost(np.array([homes]), np.array([visits]), chunk)
        p = len(pool) if always else 2
        while 2 <= p <= len(pool) and len(test):
            home, _, cell = Cells(pool[:p], threshold).place(test)
            lives, calls = (np.bincount(c, minlength=p) / len(test) for c in (home, cell))
            # visitors are taken to lie like those who live there, and meet siblings on both sides
            cost = split_cost(lives * homes, calls * homes + (lives + 2 * calls) * visits, chunk)
            if cost < best_cost:
                best, best_cost = pool[:p], cost
            p *= 2
        kept = [] if best is None else [best.tolist()]
        return pa.table({"cell": pa.array([key[0].as_py()] * len(kept), pa.int64()), "pivots": pa.array(kept, pa.list_(pa.list_(pa.float64())))})

    chosen = drawn.select("cell", "id", "homes", "visits", F.col("vec").cast(vec)).groupBy("cell")
    return chosen.applyInArrow(choose, "cell long, pivots array<array<double>>")


def _split(rows: DataFrame, pivots: DataFrame, large: DataFrame, threshold: float, chunk: int, fan_out: int) -> DataFrame:
    """The rows of split cells, in the cells below."""
    vec = rows.schema["vec"].dataType.simpleString()
    parted = large.join(pivots.select("cell"), "cell").select("cell", F.ceil((F.col("homes") + F.col("visits")) / chunk).alias("parts"))
    salted = rows.join(parted, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    beside = pivots.join(parted, "cell").select("cell", "pivots", every)

    def send(key: tuple[pa.Scalar, ...], table: pa.Table, chosen: pa.Table) -> pa.Table:
        first = key[0].as_py() * fan_out + 1
        cells = Cells(np.array(chosen["pivots"][0].as_py()), threshold) if chosen.num_rows else None
        out = []
        for role in (0, 1):
            mine = table.filter(pa.array(table["role"].to_numpy() == role))
            if cells is None or not mine.num_rows:
                continue
            x = matrix(mine["vec"])
            if role:
                sent = [(*cells.reached(x), 1)]
            else:
                home, row, cell = cells.place(x)
                sent = [(np.arange(len(x)), home, 0), (row, cell, 1)]
            for row, cell, new_role in sent:
                took = mine.take(pa.array(row))
                out.append(
                    pa.table(
                        {
                            "cell": pa.array(first + cell, pa.int64()),
                            "role": pa.array(np.full(len(row), new_role), pa.int32()),
                            **{c: took[c] for c in ("id", "weight", "vec")},
                        }
                    )
                )
        if not out:
            out = [table.select(["cell", "role", "id", "weight", "vec"]).slice(0, 0)]
        return pa.concat_tables(out, promote_options="permissive")

    groups = salted.select("cell", "part", "role", "id", "weight", "vec").groupBy("cell", "part")
    return groups.cogroup(beside.groupBy("cell", "part")).applyInArrow(send, f"cell long, role int, id long, weight long, vec {vec}")


def place_in_tree(
    points: DataFrame,
    threshold: float,
    chunk: int,
    fan_out: int = FAN_OUT,
    levels: int = MAX_LEVELS,
    always: bool = False,
) -> DataFrame:
    """``(cell, role, id, weight, vec)`` of every row in every cell it lives in or visits. ``always`` splits
    crowded cells at any price."""
    if fan_out < 2 or (fan_out + 1) ** levels >= 1 << 62:
        raise ValueError("cells of so many levels cannot be numbered")
    rows = points.select(F.lit(0).cast("long").alias("cell"), F.lit(0).cast("int").alias("role"), "id", "weight", "vec")
    closed = []
    for level in range(levels):
        large = cut(_sizes(rows).where(F.col("homes") + F.col("visits") > chunk))
        if large.isEmpty():
            break
        pivots = cut(_pivots(rows, large, level, threshold, chunk, fan_out, always))
        if pivots.isEmpty():
            break
        closed.append(rows.join(pivots.select("cell"), "cell", "left_anti"))
        rows = cut(_split(rows, pivots, large, threshold, chunk, fan_out))
    for part in closed:
        rows = rows.unionByName(part)
    return rows


def _copies(rows: DataFrame, chunk: int) -> DataFrame:
    """Every row once per pair of chunks that it takes part in."""
    homes, visits = F.ceil(F.col("homes") / chunk), F.ceil(F.col("visits") / chunk)
    beside = (F.col("homes") <= chunk) & (F.col("visits") <= chunk)  # visitors fit beside the one chunk
    chunks = _sizes(rows).select("cell", homes.alias("nh"), F.when(beside, F.lit(0)).otherwise(visits).alias("nv"))
    nh, nv, j, lives = F.col("nh"), F.col("nv"), F.col("j"), F.col("role") == 0
    turned = F.xxhash64("id", F.lit(1))
    own = F.when(lives, F.pmod(turned, nh)).otherwise(F.when(nv == 0, F.lit(0)).otherwise(nh + F.pmod(turned, F.greatest(nv, F.lit(1)))))
    times = F.when(lives, nh + nv).otherwise(nh)
    spread = rows.join(chunks, "cell").withColumn("own", own).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    own = F.col("own")
    left = F.when(~lives, j).when(j < nh, F.least(own, j)).otherwise(own)
    right = F.when(~lives, own).when(j < nh, F.greatest(own, j)).otherwise(j)
    role = F.when(lives & ((j >= nh) | (j >= own)), F.lit(0)).otherwise(F.lit(1)).cast("int")
    return spread.select("cell", left.cast("long").alias("l"), right.cast("long").alias("r"), role.alias("role"), "id", "weight", "vec")


def near_join_tree(
    points: DataFrame,
    threshold: float,
    mode: str = "pairs",
    weighted: bool = False,
    chunk: int | None = None,
    **tree,
) -> DataFrame:
    """Join ``points (id, weight, vec)`` with itself below ``threshold`` (strictly), as ``near_join`` does."""
    chunk = chunk_rows(points, points.count(), chunk)
    return compared(_copies(place_in_tree(points, threshold, chunk, **tree), chunk), threshold, mode, weighted)
