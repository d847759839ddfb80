"""Corpus pipeline: language ID, near duplicates, decontamination, secrets, packing.

Each stage takes what the one before it kept and returns the columns of documents, the last one the packed
pieces. A stage without rows gives none. Rows are told apart by their whole content where ids are
null or repeated; further columns, whatever their names, are passed on up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snippetlake.llm import decontaminate, langid, neardup, packing, queries, secrets
from snippetlake.session import cut, ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or in no language, go. Equal rows are judged alike, so the hash of a whole row
    names the decision; the rejected are few and joined by what size they turn out to have."""
    ship(spark)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash"))
    named = whole.select("hash", F.col("row.text").alias("text"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source"))
    judged = langid.judge(named, langid.Columns(key="hash"))
    rejected = cut(judged.where(~F.col("kept")).select(F.col("id").alias("hash")).distinct())
    return whole.join(rejected, "hash", "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest id stays, one without an id only if none has
    one; of rows that repeat an id and its text one stays, nameless ones too if they have words; rows without
    an id and without words stay. A key of id and text names the decision, so an id that names several texts
    loses only those that have a near duplicate."""
    ship(spark)
    named = F.col("doc_id").isNotNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    key = F.when(named, F.xxhash64("doc_id", "text")).alias("own_key")
    keyed = docs.select(key, "doc_id", "text")
    linked = neardup.components(keyed, percent=80, scheme=neardup.SCHEME_80, key="own_key")
    grouped = linked.where("id is not null").select(F.col("id").alias("own_key"), "component_id").distinct()
    several = cut(grouped.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id"))
    members = cut(grouped.join(several, "component_id").join(keyed.select("own_key", "doc_id").distinct(), "own_key"))
    # written first: the join below then has plain exchanges on both sides, and a large component can be split
    first = cut(members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "own_key")).alias("first")))
    gone = cut(members.join(first, "component_id").where(F.col("own_key") != F.col("first.own_key")).select(F.col("own_key").alias("gone_key")))
    again = cut(keyed.where("own_key is not null").groupBy(F.col("own_key").alias("again_key")).agg(F.count("*").alias("n")).where("n > 1").select("again_key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key)
    rows = rows.join(gone, F.col("own_key") == F.col("gone_key"), "left_anti")
    if again.isEmpty():
        return rows.select("row.*")
    once = rows.join(again, F.col("own_key") == F.col("again_key"), "left_anti").select("row.*")
    repeated = rows.join(again, F.col("own_key") == F.col("again_key"), "left_semi").dropDuplicates(["own_key"])
    return once.unionByName(repeated.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a test item go."""
    ship(spark)
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; secrets in its text are replaced by a mark, and ``n_chars`` follows."""
    ship(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("content"))
    found = secrets.scan(rows, secrets.new_ledger(spark), ["row"], text="content")
    text = secrets.masked(F.col("row.text"), F.col("found"))
    changed = {"text": text, "n_chars": F.when(F.size("found") > 0, F.length(text).cast("bigint")).otherwise(F.col("row.n_chars"))}
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document with their place in a sequence."""
    ship(spark)
    return packing.pack(packing.pieces(docs, queries.tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Signatures, classifiers and the linear program have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
