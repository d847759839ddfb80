"""Function extraction: sources and parse trees to one row per function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import dedent_lines, slice_lines, split_lines
from ..functions.trees import FUNCTION_NODE_TYPES, node_spans
from .joins import left_join_present


def functions_per_file(files: DataFrame, node_types: Sequence[str] = FUNCTION_NODE_TYPES, spans: Column | None = None) -> DataFrame:
    """Replace ``content`` and ``tree`` by ``functions``, an array in pre-order. ``spans`` of the
    wanted nodes stand in for the tree where they are known.

    A narrow projection: one row per file stays one row, and only the cut-out texts
    leave it. A file without a well-formed tree gets an empty array.
    """
    rest = [c for c in files.columns if c not in ("content", "tree")]

    def cut_out(lines: Column) -> Column:
        return let(
            F.size(lines),
            lambda n: F.transform(
                F.filter(node_spans(F.col("tree"), node_types) if spans is None else spans, lambda s: s["line"] < n),
                lambda s: F.struct(
                    s["line"].alias("line"),
                    s["end_line"].alias("end_line"),
                    F.array_join(dedent_lines(slice_lines(lines, s["line"], s["end_line"])), "\n").alias("text"),
                ),
            ),
        )

    functions = let(split_lines(F.col("content")), cut_out)
    empty = F.array().cast("array<struct<line:int,end_line:int,text:string>>")
    return files.select(*rest, F.coalesce(functions, empty).alias("functions"))


def explode_functions(per_file: DataFrame) -> DataFrame:
    """``(…, ord, line, end_line, text)``; files without functions vanish here.

    The outer form is meant: for the inner one the optimizer adds a test for non-empty
    arrays below the projection, which would extract everything twice.
    """
    rest = [c for c in per_file.columns if c != "functions"]
    every = per_file.select(*rest, F.posexplode_outer("functions").alias("ord", "fn")).filter(F.col("ord").isNotNull())
    return every.select(
        *rest, "ord", F.col("fn.line").alias("line"), F.col("fn.end_line").alias("end_line"), F.col("fn.text").alias("text")
    )


def join_trees(entries: DataFrame, sources: DataFrame, trees: DataFrame, missing: bool = True) -> DataFrame:
    """Manifest entries with their source and tree; ``missing`` keeps those without a tree."""
    by_tree = trees.select(F.col("path").alias("tree_path"), "tree")
    found = entries.join(sources, "path")
    joined = left_join_present(found, by_tree, "tree_path") if missing else found.join(by_tree, "tree_path")
    return joined.drop("tree_path")


def extract_functions(entries: DataFrame, sources: DataFrame, trees: DataFrame, node_types: Sequence[str] = FUNCTION_NODE_TYPES) -> DataFrame:
    files = join_trees(entries, sources.select("path", "content"), trees, missing=False)
    return explode_functions(functions_per_file(files, node_types))
