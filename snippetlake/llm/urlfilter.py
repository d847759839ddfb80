"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A list of any length becomes a filter of bounded size: 512-bit blocks, one block per URL, eight bits
in it. The filter is a table of at most ``MAX_BLOCKS`` rows, so it can be broadcast whatever the list.
Pages whose bits are all set are *possible* hits; only these are shuffled, and a hash join with the
list itself removes the false positives. Everything is DataFrame functions.

Up to ``MAX_LITERAL_RULES`` rules are a literal of the plan. More, or a table of rules, are met by hash joins: every
suffix of a host meets the lengths of its rules' paths, and the path's beginning of each such length the rules.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is
allowed; an empty list blocks nothing; null list entries are ignored; repeated rows are kept as they
are; further columns of the inputs are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snippetlake.session import cut

#: 512 bits a block: 2**16 blocks are 4 MB of bits, the most that is ever broadcast.
MAX_BLOCKS = 1 << 16
#: URLs a block when the list is short enough; about 12 bits a URL.
URLS_A_BLOCK = 40
#: Rules up to this number become a literal array in the plan; more are joined.
MAX_LITERAL_RULES = 1_000
WORDS, PROBES = 8, 8
#: Query parameters that do not name a page (fixed values).
TRACKING = "(utm_[^=&]*|ref|gclid|fbclid)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the registered query (fixed values).
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path without ``www.``, default port and closing slashes, and the query without
    tracking parameters; scheme and fragment dropped. Null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)"))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _place(key: Column, blocks: int) -> tuple[Column, list[tuple[int, Column]]]:
    """Block of a key, and for each of the eight words of the block the bit it sets there."""
    place, bits = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    return F.pmod(place, F.lit(blocks)), [(w, F.shiftrightunsigned(bits, 6 * w).bitwiseAND(F.lit(63)).cast("int")) for w in range(PROBES)]


def _bit(j: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), j)


def bloom(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """The filter as rows (block, w0 … w7); blocks nobody is in have no row."""
    block, bits = _place(F.col(url), blocks)
    rows = listed.select(block.alias("block"), *[_bit(j).alias(f"w{w}") for w, j in bits])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])


def possible(pages: DataFrame, url: str, filter_rows: DataFrame, blocks: int) -> DataFrame:
    """``pages`` with a boolean ``possible``: false only for URLs that are surely not listed."""
    block, bits = _place(F.col(url), blocks)
    probed = pages.join(F.broadcast(filter_rows), block == F.col("block"), "left")
    hit = F.coalesce(F.col("w0").isNotNull(), F.lit(False))
    for w, j in bits:
        hit = hit & (F.col(f"w{w}").bitwiseAND(_bit(j)) != 0)
    return probed.select(*[pages[c] for c in pages.columns], F.coalesce(hit, F.lit(False)).alias("possible"))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. Of equally long ones the
    longer host wins, then block."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    table = F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in rules])
    fits = F.filter(table, lambda r: (host != "") & ((host == r.host) | F.endswith(host, F.concat(F.lit("."), r.host))) & F.startswith(path, r.path))
    return F.array_max(F.transform(fits, lambda r: _weight(r.host, r.path, r.verdict)))


def _weight(host: Column, path: Column, verdict: Column) -> Column:
    """Greatest for the rule that wins."""
    return F.struct(
        (F.length(host) + F.length(path)).alias("n"),
        F.length(host).alias("h"),
        (verdict == "block").alias("b"),
        F.concat(host, path).alias("rule"),
        verdict.alias("verdict"),
    )


def fitting_rules(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, best) of the distinct ``pairs`` (host, path) that a row of ``rules`` (verdict, host, path)
    fits; as ``fitting_rule``, for any number of rules. Rows of rules with a null are ignored."""
    named = cut(rules.select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).dropna().distinct())
    lengths = named.select("rule_host", F.length("rule_path").alias("n")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    below = pairs.where("host <> ''").select("host", "path", F.explode(suffixes).alias("rule_host"))
    begun = below.join(lengths, "rule_host").where(F.col("n") <= F.length("path"))
    met = begun.withColumn("rule_path", F.expr("left(path, n)")).join(named, ["rule_host", "rule_path"])
    best = F.max(_weight(F.col("rule_host"), F.col("rule_path"), F.col("verdict")))
    return met.groupBy("host", "path").agg(best.alias("best"))


def _ruled(parts: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    if not isinstance(rules, DataFrame):
        if len(rules) <= MAX_LITERAL_RULES:
            return parts.withColumn("best", fitting_rule(F.col("host"), F.col("path"), rules))
        rules = parts.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    best = fitting_rules(parts.select("host", "path").distinct(), rules)
    return parts.join(best, ["host", "path"], "left")


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] | DataFrame = RULES, key: str = "page_id", url: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages``.

    ``listed``: table with the URLs to block in its column ``url``, in any spelling. Where a rule
    fits, it decides; else a page is blocked if its canonical URL is listed.
    """
    names = cut(listed.select(canonical(F.col("url")).alias("listed")).where("listed is not null").distinct())
    blocks = max(1, min(max_blocks, names.count() // URLS_A_BLOCK + 1))
    read = pages.select(F.col(key), F.col(url).alias("url"))
    parts = read.select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    probed = possible(_ruled(parts, rules), "canonical", bloom(names, "listed", blocks), blocks)
    pending = F.col("possible") & F.col("best").isNull()
    out = [key, "host", "path", F.col("best.rule").alias("rule")]
    settled = probed.where(~pending).select(*out, F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"))
    exact = probed.where(pending).join(names.hint("shuffle_hash"), F.col("canonical") == F.col("listed"), "left")
    return settled.unionByName(exact.select(*out, F.when(F.col("listed").isNotNull(), "block").otherwise("allow").alias("verdict")))
