"""Dense numbers in a global order, without a one-partition window.

Rows go to ranges of the order column, ranges that hold too many rows to ranges of their own, and so on: a
tree of ranges with at most ``fan_out`` below each. Totals are summed up the tree and carried down again,
so no window meets more than ``fan_out`` totals, and running sums over rows are taken in leaves only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows of the sample that splits a range.
SAMPLE_ROWS = 4096
MAX_RANGES = 512
ROWS_PER_RANGE = 8
#: Rows beyond which a range is split again, and levels of the tree at most: 512 ** 3 leaves of that size.
LEAF_ROWS, MAX_LEVELS = 1 << 20, 3
#: Split points and totals that are sent to all tasks, in bytes and rows; others are joined by range.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 1 << 16


def _sample(df: DataFrame, order_col: str) -> list:
    """The rows of least hash in order: a uniform sample of bounded size, which needs neither a count nor a sort."""
    rows = df.select(order_col).orderBy(F.xxhash64(order_col), order_col).limit(SAMPLE_ROWS)
    return rows.toPandas()[order_col].sort_values().tolist()


def range_bounds(sample: list, fan_out: int = MAX_RANGES) -> list:
    """Split points: quantiles of a sorted sample. They only spread the work; numbers do not depend on them."""
    ranges = min(fan_out, len(sample) // ROWS_PER_RANGE)
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if ranges > 1 else []


def _place(bounds: Column, order_col: str) -> Column:
    return F.size(F.filter(bounds, lambda b: b <= F.col(order_col))).cast("long")


def _split(ranged: DataFrame, large: DataFrame, order_col: str, level: int, fan_out: int) -> DataFrame:
    """``ranged`` with the ranges of ``large (_range, _rows)`` split at quantiles of samples of their own."""
    part = F.pmod(F.xxhash64(F.lit(level), order_col), F.lit(1 << 30)) / float(1 << 30)
    keys = ranged.select("_range", order_col)
    drawn = keys.join(large, "_range").where(part * F.col("_rows") < SAMPLE_ROWS)
    drawn = drawn.groupBy("_range").agg(F.array_sort(F.collect_list(order_col)).alias("_drawn"))
    at = lambda i: F.get("_drawn", F.floor(i * F.size("_drawn") / fan_out).cast("int"))
    points = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(fan_out - 1)), at))
    bounds = cut(drawn.select("_range", points.alias("_bounds")))
    size = bounds.agg(F.sum(F.aggregate("_bounds", F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b.cast("string"))))).first()[0] or 0
    bounds = F.broadcast(bounds) if size <= BROADCAST_BYTES else bounds.hint("merge")
    below = F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(_place(F.col("_bounds"), order_col))
    return ranged.join(bounds, "_range", "left").withColumn("_range", F.col("_range") * fan_out + below).drop("_bounds")


def _carried(totals: DataFrame, levels: int, fan_out: int) -> DataFrame:
    """(_range, _before): the sum of ``_total`` over all leaves before each, summed up the tree and carried down."""
    tree = [totals]
    for _ in range(levels - 1):
        tree.append(tree[-1].groupBy(F.floor(F.col("_range") / fan_out).alias("_range")).agg(F.sum("_total").alias("_total")))
    top = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = tree[-1].select("_range", F.coalesce(F.sum("_total").over(top), F.lit(0)).alias("_before"))
    among = Window.partitionBy("_parent").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    for level in reversed(tree[:-1]):
        children = level.withColumn("_parent", F.floor(F.col("_range") / fan_out))
        children = children.withColumn("_own", F.coalesce(F.sum("_total").over(among), F.lit(0)))
        parents = before.select(F.col("_range").alias("_parent"), "_before")
        before = children.join(parents, "_parent").select("_range", (F.col("_before") + F.col("_own")).alias("_before"))
    return before


def with_offsets(
    df: DataFrame,
    order_col: str,
    count_col: str | None = None,
    start: int = 0,
    out: str = "offset",
    fan_out: int = MAX_RANGES,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Add to each row ``start`` plus the sum of ``count_col`` over all rows before it.

    ``order_col`` must be unique; without ``count_col`` every row counts one. A table that its sample holds whole
    needs one level; others have the rows of their ranges counted, and ranges of more than ``leaf_rows`` are split.
    """
    if fan_out < 2:
        raise ValueError("fan_out must be at least 2")
    amount = (F.col(count_col) if count_col else F.lit(1)).cast("long")
    sample = _sample(df, order_col)
    bounds = range_bounds(sample, fan_out)
    if not bounds:
        window = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.lit(start) + F.coalesce(F.sum(amount).over(window), F.lit(0)))
    limits = F.array(*[F.lit(b) for b in bounds])
    ranged = df.withColumn("_range", _place(limits, order_col))
    levels, few = 1, True
    while len(sample) > min(leaf_rows, SAMPLE_ROWS - 1) and levels < MAX_LEVELS:
        sizes = cut(ranged.groupBy("_range").agg(F.count("*").alias("_rows")))
        large = sizes.where(F.col("_rows") > leaf_rows)
        n_large = large.count()
        few = sizes.count() + n_large * fan_out <= BROADCAST_ROWS
        if not n_large:
            break
        ranged = _split(ranged, F.broadcast(large) if n_large <= BROADCAST_ROWS else large, order_col, levels, fan_out)
        levels += 1
    totals = ranged.groupBy("_range").agg(F.sum(amount).alias("_total"))
    before = _carried(cut(totals) if levels > 1 else totals, levels, fan_out)
    within = Window.partitionBy("_range").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum(amount).over(within), F.lit(0))
    return (
        ranged.join(F.broadcast(before) if few else before.hint("merge"), "_range")
        .withColumn(out, F.lit(start) + F.col("_before") + running)
        .drop("_range", "_before")
    )
