"""Set operations between vectors, file records and function listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_key


def list_functions(files: DataFrame) -> DataFrame:
    """``(path, line, vector_id)`` from the arrays of the file records; where the arrays
    differ in length, the longer one's tail is dropped."""
    zipped = files.select("path", F.explode(F.arrays_zip(F.col("function_lines").alias("line"), F.col("vector_ids").alias("vector_id"))).alias("f"))
    return zipped.select("path", "f.line", "f.vector_id").filter(F.col("line").isNotNull() & F.col("vector_id").isNotNull())


def orphans(vectors: DataFrame, functions: DataFrame) -> DataFrame:
    """Vectors that no file record mentions."""
    return vectors.join(functions.select("vector_id"), "vector_id", "left_anti")


def prune_orphans(vectors: DataFrame, functions: DataFrame) -> DataFrame:
    return vectors.join(functions.select("vector_id"), "vector_id", "left_semi")


def vectors_by_id(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors of the given ids; ids without a vector are skipped."""
    return vectors.join(ids.select("vector_id").distinct(), "vector_id", "left_semi")


def vector_ids_of_files(functions: DataFrame, paths: DataFrame) -> DataFrame:
    return functions.join(paths.select("path").distinct(), "path", "left_semi").select("path", "vector_id")


def in_force(log: DataFrame, superseded: DataFrame) -> DataFrame:
    """Rows of a log that no later batch replaced. ``superseded (path, old_batch_id)`` is
    what the later batches wrote down: small, usually broadcast, empty after compaction."""
    old = superseded.select("path", F.col("old_batch_id").alias("batch_id"))
    return log.join(old, ["path", "batch_id"], "left_anti")


def file_records(per_file: DataFrame) -> DataFrame:
    """Records with the vector ids and lines of each file as arrays, from rows that hold
    ``function_lines`` and the file's first id ``offset``; nothing is gathered across rows."""
    n = F.size("function_lines")
    ids = F.when(n > 0, F.sequence(F.col("offset"), F.col("offset") + n - 1)).otherwise(F.array().cast("array<bigint>"))
    return per_file.select("path", file_key(F.col("path")).alias("file_key"), "md5", "mtime", ids.alias("vector_ids"), "function_lines")
