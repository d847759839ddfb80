"""Manifest of files to ingest, with the entries that cannot be used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import normalize_path
from ..operators.joins import left_join_present
from ..schema import MANIFEST_JSON


def read_manifest_json(spark: SparkSession, path: str) -> DataFrame:
    """The raw document. A manifest too long for one JSON document can be any table
    with the columns ``path`` and ``tree_path``; everything below takes such a table."""
    return spark.read.schema(MANIFEST_JSON).json(path, multiLine=True)


def manifest_entries(doc: DataFrame) -> DataFrame:
    return doc.select(F.explode("files").alias("f")).select(
        F.col("f.path").alias("path"), F.col("f.tree_sitter_file").alias("tree_path")
    )


def manifest_config(doc: DataFrame, model_name: str, batch_size: int = 32) -> DataFrame:
    """Model name and batch size: the document's own values win over the arguments."""
    return doc.select(
        F.coalesce("model_name", F.lit(model_name)).alias("model_name"),
        F.coalesce("batch_size", F.lit(batch_size)).alias("batch_size"),
    )


def usable_entries(entries: DataFrame, root: str | None = None) -> DataFrame:
    """Entries that name a source file, with normalised paths."""
    named = entries.filter(F.coalesce(F.col("path"), F.lit("")) != "")
    tree = F.when(F.coalesce(F.col("tree_path"), F.lit("")) != "", F.col("tree_path"))
    return named.select(
        normalize_path(F.col("path"), root).alias("path"),
        normalize_path(tree, root).alias("tree_path"),
    )


def manifest_rejects(entries: DataFrame, sources: DataFrame, trees: DataFrame, root: str | None = None) -> DataFrame:
    """One row per unusable entry with the reason, first failing test first."""
    tree = F.when(F.coalesce(F.col("tree_path"), F.lit("")) != "", F.col("tree_path"))
    norm = entries.select(
        F.when(F.coalesce(F.col("path"), F.lit("")) != "", normalize_path(F.col("path"), root)).alias("path"),
        normalize_path(tree, root).alias("tree_path"),
    )
    have_source = sources.select("path", F.lit(True).alias("has_source"))
    have_tree = trees.select(F.col("path").alias("tree_path"), F.lit(True).alias("has_tree"))
    joined = left_join_present(left_join_present(norm, have_source, "path"), have_tree, "tree_path")
    reason = (
        F.when(F.col("path").isNull(), "no path")
        .when(F.col("has_source").isNull(), "source not found")
        .when(F.col("tree_path").isNull(), "no tree path")
        .when(F.col("has_tree").isNull(), "tree not found")
    )
    return joined.select("path", "tree_path", reason.alias("reason")).filter(F.col("reason").isNotNull())
