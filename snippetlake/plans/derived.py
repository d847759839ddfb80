"""Code-search inputs derived from the given tables.

The tables hold no source code, so documents stand for source files: a document gives
a path, a text and a parse tree whose blocks of three lines are functions. Every table
is whole; case expressions decide which defect a row carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from ..session import spread

BASE_SECONDS = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path(root: str = "/proj/") -> Column:
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".js").when(F.col("lang") == "de", ".go").otherwise(".rs")
    return F.concat(F.lit(root), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext)


def document_content() -> Column:
    indented = F.concat(F.lit("    "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n    ")))
    return F.when(F.col("doc_id") % 2 == 0, indented).otherwise(F.col("text"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, path, content, md5, mtime)``, one source file per document."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id",
        document_path().alias("path"),
        document_content().alias("content"),
    ).select(
        "doc_id",
        "path",
        "content",
        F.md5(F.col("content").cast("binary")).alias("md5"),
        F.timestamp_seconds(F.lit(BASE_SECONDS) + F.col("doc_id")).alias("mtime"),
    )


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, bytes, mtime)`` as a file scan gives them: three kinds of line ends, and some files that
    are not valid UTF-8."""
    d = spread(table(spark, sf_dir, "documents"))
    i = F.col("doc_id")
    ended = F.when(i % 4 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(i % 4 == 1, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.col("text"))
    spoilt = F.when(i % 29 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    return d.select(document_path().alias("path"), F.concat(ended.cast("binary"), spoilt).alias("bytes"), F.timestamp_seconds(F.lit(BASE_SECONDS) + i).alias("mtime"))


def landed_files(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Documents and their trees as files below ``folder``, written inside tasks, and a manifest of one entry a
    line beside them, whose path is returned."""
    raw = raw_files(spark, sf_dir).select(F.substring("path", 7, 1000).alias("name"), "bytes")
    tree = trees(spark, sf_dir).select(F.substring("path", 7, 1000).alias("name"), F.col("tree").cast("binary").alias("bytes"))

    def land(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        made = set()
        for batch in batches:
            for file, content in zip(batch["name"].to_pylist(), batch["bytes"].to_pylist()):
                if (below := file.rpartition("/")[0]) not in made:
                    system.create_dir(f"{root}/files/{below}")
                    made.add(below)
                with system.open_output_stream(f"{root}/files/{file}") as out:
                    out.write(content)
            yield batch.select(["name"])

    raw.unionByName(tree).mapInArrow(land, "name string").write.format("noop").mode("overwrite").save()
    entries = manifest(spark, sf_dir)
    relative = [F.regexp_replace(c, r"^/proj/(\./lib/\.\./)?", "./x/../").alias(n) for c, n in (("path", "path"), ("tree_path", "tree_sitter_file"))]
    entries.select(*relative).write.json(f"{folder}/manifest")
    return f"{folder}/manifest"


def tree_text(n_lines: Column, doc_id: Column) -> Column:
    """Parse tree of a document with ``n_lines`` lines."""

    def block(i: Column, start: Column, end: Column) -> Column:
        span = F.when((doc_id % 17 == 0) & (i == 0), F.lit("")).otherwise(F.format_string(" [%d, 0] - [%d, 9]", start, end))
        nested = F.when(
            (i % 2 == 0) & (end > start),
            F.format_string("\n  body: (block [%d, 0] - [%d, 9] (method_definition [%d, 2] - [%d, 9] (identifier [%d, 3] - [%d, 5])))", start, end, start + 1, end, start + 1, start + 1),
        ).otherwise(F.lit(""))
        return F.concat(F.lit("\n (function_definition"), span, F.format_string("\n  name: (identifier [%d, 4] - [%d, 7])", start, start), nested, F.lit(")"))

    broken = F.when(doc_id % 11 == 0, F.lit('\n (MISSING ";" [0, 0] - [0, 0])')).otherwise(F.lit(""))
    tail = F.when(doc_id % 13 == 0, F.lit("\nfile.x  Parse: 0.05 ms (ERROR [0, 0] - [0, 1])")).otherwise(F.lit(""))

    def tree(last: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(last / 3).cast("int")), lambda i: block(i, i * 3, F.least(i * 3 + 2, last)))
        return F.concat(F.format_string("(module [0, 0] - [%d, 0]", last), F.array_join(blocks, ""), broken, F.lit(")"), tail)

    return let((n_lines - 1).cast("int"), tree)


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, tree)`` keyed by the tree file's path."""
    s = sources(spark, sf_dir)
    n_lines = F.size(F.split("content", "\n", -1))
    return s.select(F.concat("path", F.lit(".tree")).alias("path"), tree_text(n_lines, F.col("doc_id")).alias("tree"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry per document, some without a path or a tree, and one missing file per source."""
    d = spread(table(spark, sf_dir, "documents"))
    path = document_path("/proj/./lib/../")
    entries = d.select(
        F.when(F.col("doc_id") % 23 == 0, "").otherwise(path).alias("path"),
        F.when(F.col("doc_id") % 19 != 0, F.concat(path, F.lit(".tree"))).alias("tree_path"),
    )
    missing = d.select("source").distinct().select(
        F.concat(F.lit("/proj/"), "source", F.lit("/gone.py")).alias("path"),
        F.concat(F.lit("/proj/"), "source", F.lit("/gone.py.tree")).alias("tree_path"),
    )
    return entries.unionByName(missing)


def snapshot(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """State of all files at version 1 or 2. Between them every tenth file is renamed
    (deleted and new), others get one more line, a new time, or a time within tolerance."""
    s = sources(spark, sf_dir)
    if version == 1:
        return s
    i = F.col("doc_id")
    renamed, edited, touched, drifted = i % 10 == 9, i % 7 == 0, i % 5 == 0, i % 3 == 0
    content = F.when(~renamed & edited, F.concat("content", F.lit("\nend"))).otherwise(F.col("content"))
    micros = F.when(renamed, 0).when(edited | touched, 60_000_000).when(drifted, 50_000).otherwise(0)
    return s.select(
        "doc_id",
        F.when(renamed, F.concat(F.lit("/proj/moved"), F.substring("path", 6, 1000))).otherwise(F.col("path")).alias("path"),
        content.alias("content"),
        F.timestamp_micros(F.unix_micros("mtime") + micros).alias("mtime"),
    ).select("doc_id", "path", "content", F.md5(F.col("content").cast("binary")).alias("md5"), "mtime")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vector_id, path, line, embedding)``: the embeddings, as functions of the document
    with the same number; vectors without a document keep a path of their own."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", document_path().alias("path"), F.size(F.split("text", "\n", -1)).alias("n_lines")
    )
    e = table(spark, sf_dir, "embeddings")
    return e.join(d, e.vec_id == d.doc_id, "left").select(
        F.col("vec_id").alias("vector_id"),
        F.coalesce("path", F.concat(F.lit("/proj/none/"), F.col("vec_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.coalesce(F.col("vec_id") % F.col("n_lines"), F.lit(0)).cast("int").alias("line"),
        "embedding",
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vector of each label, as queries."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("query_id"))
    return e.join(first.select("query_id"), F.col("vec_id") == F.col("query_id")).select("query_id", "embedding")


def live_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function listing with live metadata: the labelled documents."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vector_id"))


def allowed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files a search is restricted to: documents labelled as of good quality."""
    d = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    return d.join(good, "doc_id", "left_semi").select(document_path().alias("path"))


def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as functions to search and cluster: ``(vector_id, path, line, text)``."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("vector_id"), document_path().alias("path"), F.lit(0).alias("line"), "text"
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def some_blank_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages, of which every third is empty or white space."""
    i = F.col("item_id")
    text = F.when(i % 6 == 0, "").when(i % 6 == 3, " \n\t ").otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(i.alias("query_id"), text.alias("text"))
