"""Secret scans with an incremental ledger of blobs.

Every version of every file is named by the SHA-256 of its content. The ledger holds, for each blob,
which rule versions have scanned it and what they found, so a run scans only the (blob, rule version)
pairs it has not seen; findings are then joined back to all paths that hold the blob. Everything is
DataFrame functions on the main path.

Defined cases: null content counts as empty; a repeated row gets its findings again; overlapping
findings of different kinds are all kept; positions are code points, the end exclusive; further
columns of the history are returned untouched only if named in ``keys``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snippetlake.functions.binding import let
from snippetlake.session import cut, shared_dir


class Rule(NamedTuple):
    """``pattern`` finds leftmost non-overlapping matches; those whose ``group`` is shorter than
    ``least`` code points are dropped after they were matched. Change ``version`` with the pattern."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds (fixed values), in the order they are listed.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # the runs below are maximal, so asking for the length inside the pattern drops the same matches
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Kinds that this library adds.
RULES = (
    *BASE,
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
SPAN = "struct<start:int,rank:int,end:int,tag:string>"
#: Findings of a text that one fold goes over. A fold copies what it has gathered at every step, so the
#: findings of a text go through it in portions, each told how far those before it reach.
PORTION = 256


def _portions(items: Column) -> Column:
    """``items``, which are some, in portions of ``PORTION``."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(PORTION)), lambda i: F.slice(items, i, F.lit(PORTION)))


def _before(totals: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each portion what ``add`` makes of the totals of those before it, from 0."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct(add(acc.at, x).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out"))
    return F.aggregate(totals, start, step, lambda acc: acc.out)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end, tag). The text between matches and the matches themselves give
    the positions; texts without a match cost one search."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(found, F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("group"),
    )
    none = F.array().cast(f"array<{SPAN}>")
    # arrays_zip pads: the last gap has no match
    past = lambda x: x.gap + F.coalesce(x["size"], F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        begin = acc.at + x.gap
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + x["size"]).alias("end"), F.lit(rule.tag).alias("tag"))
        return F.struct((acc.at + past(x)).alias("at"), F.when(x["group"] >= rule.least, F.concat(acc.out, F.array(span))).otherwise(acc.out).alias("out"))

    def placed(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda at, x: at + past(x)))
        begins = _before(totals, lambda at, x: at + x)
        folded = F.zip_with(parts, begins, lambda p, at: F.aggregate(p, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc.out))
        return F.flatten(folded)

    return F.when(F.size(found) > 0, let(sizes, lambda x: let(_portions(x), placed))).otherwise(none)


class Ledger:
    """Parquet log of (blob, tags scanned, spans found), in a folder all executors share."""

    SCHEMA = f"blob string, tags array<string>, found array<{SPAN}>"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame | None:
        """All rows, or None before the first batch."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder) if self._exists() else None

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.folder)


def new_ledger(spark: SparkSession) -> Ledger:
    return Ledger(spark, f"{shared_dir(spark).rstrip('/')}/blob-ledger-{uuid.uuid4().hex}")


def update(history: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, text: str = "text") -> None:
    """Scan the (blob, rule version) pairs of ``history`` that the ledger has not seen.

    Copies meet before anything is shuffled, so a blob that makes up a third of the rows is sent
    once per task at most.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    blobs = history.select(F.sha2(content, 256).alias("blob"), content.alias("text")).dropDuplicates(["blob"])
    every = F.array(*[F.lit(r.tag) for r in rules])
    log = ledger.read()
    if log is None:
        pending = blobs.withColumn("tags", every)
    else:
        seen = log.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("seen"))
        unseen = F.array_except(every, F.coalesce(F.col("seen"), F.array().cast("array<string>")))
        pending = blobs.join(seen, "blob", "left").withColumn("tags", unseen).where(F.size("tags") > 0).drop("seen")
    none = F.array().cast(f"array<{SPAN}>")
    parts = [F.when(F.array_contains("tags", r.tag), spans(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules)]
    ledger.append(pending.select("blob", "tags", F.concat(*parts).alias("found")))


def findings(history: DataFrame, ledger: Ledger, keys: Sequence[str], rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``keys`` of every row of ``history``, its ``blob`` and its ``found`` spans by start, then kind."""
    names = history.select(*keys, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))
    wanted = F.array(*[F.lit(r.tag) for r in rules])
    log = ledger.read()
    hits = log.select("blob", F.filter("found", lambda s: F.array_contains(wanted, s.tag)).alias("found")).where(F.size("found") > 0)
    # written first: the join below then has plain exchanges on both sides, and a hot blob can be split
    ordered = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    # repeated spans are neighbours by now
    once = let(F.col("found"), lambda a: F.filter(a, lambda s, i: (i == 0) | ~s.eqNullSafe(F.get(a, i - 1))))
    by_blob = cut(ordered.select("blob", once.alias("found")))
    joined = names.join(by_blob, "blob", "left")
    return joined.select(*keys, "blob", F.coalesce("found", F.array().cast(f"array<{SPAN}>")).alias("found"))


def scan(history: DataFrame, ledger: Ledger, keys: Sequence[str], rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Update the ledger, then return the findings of every row of ``history``."""
    update(history, ledger, rules, text)
    return findings(history, ledger, keys, rules, text)


def joined_spans(found: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.split_part(s.tag, F.lit("@"), F.lit(1)), s.start, s.end)), ",")


def masked(text: Column, found: Column, mark: str = "<secret>") -> Column:
    """``text`` with every found span replaced; overlapping spans share one mark."""

    def portion(own: Column, p: Column, base: Column) -> Column:
        """The stretch ``own`` of the text, which starts at ``base``, with the spans of one portion replaced."""

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(own, acc.at + 1, s.start - base - acc.at)
            return F.struct(
                F.greatest(acc.at, s.end - base).alias("at"),
                F.when(s.start - base < acc.at, acc.out).otherwise(F.concat(acc.out, gap, F.lit(mark))).alias("out"),
            )

        return F.aggregate(p, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: acc.out)

    def whole(t: Column, parts: Column) -> Column:
        reach = lambda p: F.array_max(F.transform(p, lambda s: s.end))
        bases = _before(F.transform(parts, reach), F.greatest)
        pieces = F.zip_with(parts, bases, lambda p, at: let(F.substring(t, at + 1, F.greatest(reach(p) - at, F.lit(0))), lambda own: portion(own, p, at)))
        rest = let(F.array_max(F.transform(parts, reach)), lambda at: F.substring(t, at + 1, F.length(t)))
        return F.concat(F.array_join(pieces, ""), rest)

    return F.when(F.size(found) > 0, let(text, lambda t: let(_portions(found), lambda parts: whole(t, parts)))).otherwise(text)
