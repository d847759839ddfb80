"""The numbered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snippetlake.llm import decontaminate, divergence, filteraudit, langid, neardup, packing, secrets, substrings, tokenout, topk, toxicity, urlfilter, warc
from snippetlake.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    out = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: Host labels of the list that op8 blocks (fixed values).
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The URL list: every page of the listed hosts."""
    labels = "|".join(LISTED_LABELS)
    return pages.select("url").where(urlfilter.host_of(F.col("url")).rlike(rf"(^|\.)({labels})\."))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, listed_urls(pages))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenout.new_folder(spark)
    tokenout.write(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return tokenout.read(spark, folder).withColumnRenamed("doc", "doc_id")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the base rules first; then all, of which only the added ones are unseen."""
    docs, ledger = table(spark, sf_dir, "documents"), secrets.new_ledger(spark)
    secrets.update(docs, ledger, secrets.BASE)
    found = secrets.scan(docs, ledger, ["doc_id"])
    base = F.filter("found", lambda s: s.tag.isin([r.tag for r in secrets.BASE]))
    tags = F.transform(base, lambda s: s.tag)
    return found.select(
        "doc_id",
        *[(F.size(tags) - F.size(F.array_remove(tags, r.tag))).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE],
        F.sha2(secrets.joined_spans(base), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("found")).alias("spans"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.pages(warc.transactions(cut(warc.records(spark, folder))))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op3_decontamination": op3_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op4_packing": op4_packing,
    "op5_near_dedup": op5_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_top_k": op7_top_k,
    "op8_url_filter": op8_url_filter,
    "op9_token_output": op9_token_output,
    "op10_secret_scan": op10_secret_scan,
    "op11_warc": op11_warc,
    "op12_filter_audit": op12_filter_audit,
    "op13_source_divergence": op13_source_divergence,
}
