"""Audit of how document filters interact, over every order in which they can be applied.

A document's failures are one bit mask. Documents are counted by (part, mask), at most 32 cells a part
whatever its size; then each cell folds across the constant array of orders with ``aggregate`` and
``transform`` into one struct per order and step, weighted by the cell's counts, and the cells of a part are merged
by elementwise sums. Everything is DataFrame functions; the texts themselves are read once and never shuffled.

Identical texts are found by SHA-256: one least id per repeated digest, joined back to narrow rows, so a
group of copies of any size meets one row, and adaptive execution may split it.

Defined cases: null text and null part are empty strings; a text without words passes B and C; rows without an
id fail E if some row with an id holds the same text, as no id of their own is smaller; rows that repeat an id
are documents of their own and do not fail E through each other; a document counts as good or
toxic if any row of ``labels`` with its id says so; null labels say nothing; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snippetlake.functions.binding import let
from snippetlake.operators.joins import left_join_present
from snippetlake.session import cut

#: The filters (fixed values): under 200 words, under half of the words distinct, over 2 % capitals, holds a
#: special character, identical to the text of a smaller id.
LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SPECIAL = r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that ``text`` (not null) fails."""
    words = F.array_remove(F.split(text, SPACE), "")
    counts = let(words, lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))
    chars = F.length(text).cast("long")
    capitals = chars - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [
        counts["all"] < LEAST_WORDS,
        F.lit(100) * counts["distinct"] < F.lit(LEAST_DISTINCT) * counts["all"],
        capitals * 100 > chars * MOST_CAPITALS,
        text.rlike(SPECIAL),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def masked(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic) of every document, E included."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(key).cast("bigint").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        text_mask(content).alias("mask"),
        F.unhex(F.sha2(content, 256)).alias("digest"),
    )
    narrow = cut(narrow)
    says = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(name)
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").cast("string").alias("name"))
    flags = cut(flags.agg(says("quality"), says("toxic")).where("quality or toxic"))
    # written first: both joins then have plain exchanges, and a hot id or text can be split
    least = narrow.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    least = cut(least.where("copies > 1 and least is not null").select("digest", "least"))
    labelled = left_join_present(narrow.withColumn("name", F.col("id").cast("string")), flags, "name")
    joined = labelled.join(least, "digest", "left")
    copy = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    yes = lambda name: F.coalesce(name, F.lit(False)).cast("long")
    return joined.select(
        "part",
        (F.col("mask") + F.when(copy, 1 << LETTERS.index("E")).otherwise(0)).alias("mask"),
        yes("quality").alias("good"),
        yes("toxic").alias("toxic"),
    )


def _orders(letters: str) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def _fold(cell: Column, orders: Column) -> Column:
    """One struct per order and step: what the filter of that step does to the rows of ``cell``."""
    none = F.lit(0).cast("long")
    row_type = ", ".join(f"{m}: bigint" for m in MEASURES)

    def step(acc: Column, bit: Column) -> Column:
        fails, here = cell["mask"].bitwiseAND(bit) != 0, acc["gone"] == 0
        weights = {
            "kept": (here & ~fails, "n"),
            "removed": (here & fails, "n"),
            "redundant": (~here & fails, "n"),
            "unique_fails": (cell["mask"] == bit, "n"),
            "good_lost": (here & fails, "good"),
            "toxic_lost": (here & fails, "toxic"),
        }
        row = F.struct(*[F.when(c, cell[w]).otherwise(none).alias(m) for m, (c, w) in weights.items()])
        return F.struct(acc["gone"].bitwiseOR(cell["mask"].bitwiseAND(bit)).alias("gone"), F.concat(acc["out"], F.array(row)).alias("out"))

    start = F.struct(F.lit(0).alias("gone"), F.array().cast(f"array<struct<{row_type}>>").alias("out"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda acc: acc["out"])))


def interactions(rows: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """(part, filter_order, step, measures, shapley) of rows (part, mask, good, toxic); bit ``k`` of
    the mask is the filter ``letters[k]``."""
    letters = "".join(letters)
    steps, orders = len(letters), _orders(letters)
    bits = F.lit([[1 << letters.index(x) for x in o] for o in orders])
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # at most 2 ** len(letters) cells a part
    parts = cells.groupBy("part").agg(F.collect_list(F.struct(F.col("mask"), "n", "good", "toxic")).alias("cells"))
    nothing = F.struct(*[F.lit(0).cast("long").alias(m) for m in MEASURES])
    plus = lambda a, b: F.struct(*[(a[m] + b[m]).alias(m) for m in MEASURES])
    merged = F.aggregate("cells", F.array_repeat(nothing, steps * len(orders)), lambda acc, c: F.zip_with(acc, _fold(c, bits), plus))
    flat = F.flatten(bits)
    removed_by = lambda bit: F.aggregate(
        F.zip_with(flat, "merged", lambda b, m: F.when(b == bit, m["removed"]).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    summed = parts.select("part", merged.alias("merged"))
    summed = summed.select("part", "merged", F.transform(F.lit([1 << k for k in range(steps)]), removed_by).alias("shapley"))
    each = summed.select("part", "shapley", F.posexplode("merged").alias("at", "m"))
    order = (F.col("at") / steps).cast("int")
    letter = F.lit([letters.index(x) for o in orders for x in o])
    return each.select(
        "part",
        F.lit(orders)[order].alias("filter_order"),
        (F.col("at") % steps + 1).cast("int").alias("step"),
        *[F.col("m")[m].alias(m) for m in MEASURES],
        F.col("shapley")[letter[F.col("at")]].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step."""
    return interactions(masked(docs, labels, key, text, part))
