"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A text's set of five-word shingles becomes a signature of 16-bit symbols, each the hash of a minimum
over the set. Two signatures of at most ``limit`` different symbols must, by the pigeonhole principle,
have at most ``errors`` different symbols in one of their chunks; so each chunk is looked up under
every choice of symbols that may differ, and no pair within the limit is missed. The limit lies about five
standard deviations beyond the expected distance at the wanted similarity. Candidates are confirmed
on the full sets.

Texts of equal sets are one class from the start. Rows that share a key are not paired with each other:
each meets one hub of the key, and only rows of keys that then hold several components stay open. Shared keys are found
by an aggregation that combines before the shuffle, so no group is gathered in a task. Open rows
are measured by the shingles they share with any other open row: a row whose own shingles alone put it below
the wanted similarity meets nobody, and two rows meet only over one of their rarest shared shingles, as few
as the similarity allows to miss. There they meet hubs of the largest component first, which joins most that
belong together, and then whatever is still possible. That last round needs no signature, so no link between open
rows is lost.

Defined cases: texts without words, or null, are linked with nothing; rows without an id are their own;
repeated rows are copies; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snippetlake.llm import words
from snippetlake.llm.tokenout import slices, small_batches
from snippetlake.llm.tokens import forget
from snippetlake.operators.components import connected_components
from snippetlake.session import cut


class Scheme(NamedTuple):
    """Signatures of ``chunks * width`` symbols; ``chunks * (errors + 1) > limit`` must hold."""

    chunks: int
    width: int
    errors: int
    limit: int


#: For a similarity of 0.85 (expected distance 7.5 of 50, deviation 2.5) and of 0.8 (10.4 of 52, 2.9).
SCHEME_85, SCHEME_80 = Scheme(10, 5, 1, 19), Scheme(13, 4, 1, 25)
#: Hubs a row is confirmed against in the round of chunk keys, nearest signatures first.
NEAREST = 2
#: Rounds, at most, in which open rows meet one hub under each of their rare shingles; they end once fewer than
#: one pair in ``WORTH`` is a link. What they leave open is compared in full, so neither changes the result.
HUB_TURNS, WORTH = 1, 20
SIGNED = "id bigint, n_shingles bigint, set_low bigint, set_high bigint, signature binary"


def _signed(scheme: Scheme):
    symbols = scheme.chunks * scheme.width
    rng = np.random.default_rng(7)
    keys, odd = rng.integers(0, 1 << 63, symbols, np.uint64), rng.integers(0, 1 << 63, symbols, np.uint64) * np.uint64(2) + np.uint64(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, "text"):
            flat, bounds = words.split(batch.column(1), lower=True)
            sets, cuts = words.shingles(words.hashed(flat), bounds)
            sizes = np.diff(cuts)
            some = np.flatnonzero(sizes)
            out = np.zeros((batch.num_rows, symbols), np.uint16)
            low, high = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            if len(some):
                at = cuts[:-1][some]
                for j in range(symbols):
                    out[some, j] = words.mix(np.minimum.reduceat((sets ^ keys[j]) * odd[j], at)).astype(np.uint16)
                low[some], high[some] = (np.add.reduceat(words.mix(sets, s), at) for s in (1, 2))
            none = pa.array(sizes == 0)
            yield pa.record_batch(
                {
                    "id": batch.column(0),
                    "n_shingles": pa.array(sizes),
                    "set_low": pa.compute.if_else(none, None, pa.array(low.view(np.int64))),
                    "set_high": pa.compute.if_else(none, None, pa.array(high.view(np.int64))),
                    "signature": pa.array([r.tobytes() for r in out], pa.binary()),
                }
            )

    return work


def _keys(scheme: Scheme):
    choices = [list(c) for c in combinations(range(scheme.width), scheme.width - scheme.errors)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, scheme.chunks, scheme.width)
            ids = batch.column(0).to_numpy()
            for c in range(scheme.chunks):
                for k, kept in enumerate(choices):
                    part = signature[:, c, kept].astype(np.uint64)
                    key = np.full(len(ids), c * len(choices) + k, np.uint64)
                    for j in range(len(kept)):
                        key = words.mix(key ^ part[:, j], j + 1)
                    yield pa.record_batch({"key": pa.array(key.view(np.int64)), "id": pa.array(ids)})

    return work


def _distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
        yield pa.record_batch({"a": batch.column(0), "b": batch.column(1), "distance": pa.array((a != b).sum(1).astype(np.int32))})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in slices(batches, "text"):
        flat, bounds = words.split(batch.column(1), lower=True)
        sets, cuts = words.shingles(words.hashed(flat), bounds)
        yield pa.record_batch({"id": batch.column(0), "set": pa.array([sets[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})


def _confirmed(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.record_batch({"a": kept.column(0), "b": kept.column(1)})

    return work


def _paired(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """(a, b, value of a, value of b) for pairs of ids."""
    left = pairs.join(table.select(F.col("id").alias("a"), F.col(value).alias("x")), "a")
    return left.join(table.select(F.col("id").alias("b"), F.col(value).alias("y")), "b").select("a", "b", "x", "y")


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        sizes = np.array([len(x) for x in numbers], np.int64)
        yield pa.record_batch(
            {
                "id": batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                "size": pa.array(np.repeat(sizes, sizes)),
                "shingle": pa.array(np.concatenate([np.zeros(0, np.int64), *numbers])),
            }
        )


def _rare_shingles(rows: DataFrame, sets: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """(shingle, id, component, weight, shared, size, place): the rarest shared shingles of ``rows (id, component)``.

    With s shared of its n shingles a row overlaps another in s at most. Pairs that reach the similarity share one of
    the ``n - ceil(percent * n / 100) + 1`` rarest shingles of either.
    """
    each = cut(sets.join(rows.select("id"), "id", "left_semi").select("id", "set").mapInArrow(_numbers, "id bigint, size bigint, shingle bigint"))
    common = cut(each.groupBy("shingle").agg(F.count("*").alias("rows")).where("rows > 1"))
    met = each.join(common, "shingle")
    shared = met.groupBy("id").agg(F.count("*").alias("shared"), F.first("size").alias("size")).where(F.col("shared") * 100 >= percent * F.col("size"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("rows", "shingle")) + F.col("size") - F.col("shared")
    first = met.join(shared.drop("size"), "id").withColumn("place", place)
    first = first.where(F.col("place") <= F.col("size") - F.ceil(percent * F.col("size") / 100) + 1)
    weights = named.groupBy("component").agg(F.count("*").alias("weight"))
    with_weight = rows.join(weights, "component", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
    return cut(first.join(with_weight, "id").select("shingle", "id", "component", "weight", "shared", "size", "place"))


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether rows ``a`` and ``b`` can reach the similarity: at the first shingle that two rows share, what
    either has from there on bounds what they share."""
    x, y = F.col(a), F.col(b)
    most = F.least(x["shared"], y["shared"], x["size"] - x["place"] + 1, y["size"] - y["place"] + 1)
    return (x["component"] != y["component"]) & (most * (100 + percent) >= percent * (x["size"] + y["size"]))


def _mixed(placed: DataFrame, *values: Column) -> DataFrame:
    """Shingles that several components share, with ``values`` aggregated over their rows."""
    groups = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), *values)
    return groups.where("low < high").drop("low", "high")


def _row() -> Column:
    return F.struct("id", "component", "shared", "size", "place")


def _hub_pairs(placed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of every row with one hub of each of its shingles: some row of the largest of its components,
    another one under another shingle, so that a row tries several."""
    pick = F.struct("weight", F.xxhash64(F.lit(turn), "shingle", "component").alias("c"), F.xxhash64(F.lit(turn), "shingle", "id").alias("i"))
    hubs = cut(_mixed(placed, F.max_by(_row(), pick).alias("y")))
    met = placed.select("shingle", _row().alias("x")).join(hubs, "shingle").where(_possible("x", "y", percent))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _all_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) under a shingle that are still possible. Of its components the one that is largest in
    the table meets the others only, never itself."""
    main = cut(_mixed(placed, F.max(F.struct("weight", "component")).alias("largest")))
    open_rows = cut(placed.join(main.select("shingle", F.col("largest.component").alias("main")), "shingle").select("shingle", "main", _row().alias("y")))
    left = open_rows.where(F.col("y.component") != F.col("main")).select("shingle", F.col("y").alias("x"))
    return left.join(open_rows, "shingle").where(_possible("x", "y", percent)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def components(docs: DataFrame, percent: int = 85, scheme: Scheme = SCHEME_85, key: str = "doc_id", text: str = "text", trace: list[int] | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``: rows are linked where
    ``100 * intersection >= percent * union`` of their shingle sets, and a component is named by its
    smallest id. ``trace`` gets the number of pairs that each round confirms on full sets."""
    if scheme.chunks * (scheme.errors + 1) <= scheme.limit:
        raise ValueError("too few chunks for the limit")
    small_batches(docs.sparkSession)
    read = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    signed = cut(read.mapInArrow(_signed(scheme), SIGNED))
    classes = cut(signed.where("n_shingles > 0 and id is not null").groupBy("set_low", "set_high").agg(F.min("id").alias("id")))
    heads = signed.select("id", "set_low", "set_high", "signature").where("set_low is not null").dropDuplicates(["id", "set_low", "set_high"])
    heads = cut(heads.join(classes, ["id", "set_low", "set_high"], "left_semi").select("id", "signature"))
    # an id that names two different texts heads two classes: its rows meet under every text
    keyed = heads.mapInArrow(_keys(scheme), "key bigint, id bigint")
    shared = cut(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("most")).where("hub < most").select("key", "hub"))
    members = cut(keyed.join(shared, "key"))
    wanted = members.select("id").distinct()
    # merged at every size: which texts are wanted grows with the texts
    sets = cut(read.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(_sets, "id bigint, set binary"))

    def confirm(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The distinct pairs, and those that reach the similarity on their full sets."""
        tried = cut(pairs.distinct())
        if trace is not None:
            trace.append(tried.count())
        return tried, cut(_paired(tried, sets, "set").mapInArrow(_confirmed(percent), "a bigint, b bigint").distinct())

    def named(links: list[DataFrame]) -> DataFrame:
        every = functools.reduce(DataFrame.unionByName, links)
        return cut(connected_components(every.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "id"))

    def fresh(pairs: DataFrame, tried: list[DataFrame]) -> DataFrame:
        ordered = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        return ordered.join(functools.reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")

    def relabelled(rows: DataFrame, names: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c != "component"]
        return cut(rows.select(*others).join(names, "id", "left").select(*others, F.coalesce("component", "id").alias("component")))

    # every row meets the smallest id of its keys, if that is among the nearest
    near = _paired(members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), heads, "signature")
    near = near.mapInArrow(_distance, "a bigint, b bigint, distance int").where(F.col("distance") <= scheme.limit)
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where(F.col("n") <= NEAREST)
    first, linked = confirm(near.select("a", "b"))
    tried, links = [first], [linked]
    # rows under keys that hold several components are open
    halfway = named(links)
    placed = relabelled(members.select("key", "id"), halfway)
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rows = cut(placed.join(cut(mixed.select("key")), "key", "left_semi").select("id", "component").distinct())
    under = _rare_shingles(rows, sets, halfway, percent)
    # open rows meet hubs as long as that joins many, and then all that are still possible
    for turn in range(HUB_TURNS):
        more, linked = confirm(fresh(_hub_pairs(under, turn, percent), tried))
        tried, links = [*tried, more], [*links, linked]
        halfway = named(links)
        weights = cut(halfway.groupBy("component").agg(F.count("*").alias("weight")))
        under = relabelled(under.drop("weight"), halfway).join(weights, "component", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
        under = cut(under.select("shingle", "id", "component", "weight", "shared", "size", "place"))
        if more.count() > WORTH * linked.count():
            break
    _, linked = confirm(fresh(_all_pairs(under, percent), tried))
    final = named([*links, linked])
    of_set = cut(classes.join(final, "id", "left").select("set_low", "set_high", F.coalesce("component", "id").alias("component_id")))
    out = signed.select("id", "n_shingles", "set_low", "set_high").join(of_set, ["set_low", "set_high"], "left")
    return out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
