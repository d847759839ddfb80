"""Spans of nodes in trees of any size: one tree is worked off by several tasks.

A text is cut at places no token reaches over, and its pieces are spread over all tasks. Each piece is tokenised alone
and sums itself up (change of depth, lowest depth, a token out of place). Running sums of the summaries, which are
narrow, tell the piece in which the root closes; only that one is looked at again, from its true depth. Spans stay in
their pieces until the tree is known to be well formed.

Defined cases: null, empty and malformed texts give no spans; what follows the root is ignored; a text without a place
to cut is one piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.trees import FUNCTION_NODE_TYPES, piece_summary, token_count, token_spans, tree_pieces, tree_tokens
from ..session import cut
from .extract import explode_functions, functions_per_file

PIECE_CHARS = 1 << 20


def piece_rows(trees: DataFrame, key: str, chars: int) -> DataFrame:
    """``(key, piece, text)``, spread over all tasks."""
    every = trees.select(key, F.posexplode(tree_pieces(F.col("tree"), chars)).alias("piece", "text"))
    return every.repartition(key, "piece")


def node_spans_in_pieces(trees: DataFrame, node_types: Sequence[str] = FUNCTION_NODE_TYPES, key: str = "path", chars: int = PIECE_CHARS) -> DataFrame:
    """``(key, spans)`` of all trees ``(key, tree)`` with a wanted node, ``key`` being unique."""
    pieces = cut(piece_rows(trees, key, chars))
    looked = let(
        tree_tokens(F.col("text")),
        lambda t: F.struct(piece_summary(t, F.col("piece") == 0).alias("sum"), token_spans(t, node_types).alias("spans")),
    )
    summed = cut(pieces.select(key, "piece", looked.alias("s")).select(key, "piece", "s.sum.*", "s.spans"))

    before = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    narrow = summed.select(key, "piece", "delta", "low", "bad")
    depths = narrow.withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)))
    closing = F.min(F.when(F.col("depth") + F.col("low") <= 0, F.struct("piece", "depth")))
    ends = depths.groupBy(key).agg(closing.alias("end"), F.min(F.when(F.col("bad"), F.col("piece"))).alias("bad"))
    # a bad token in the closing piece may follow the root, so the look from the true depth decides on it
    ends = ends.where("end is not null and coalesce(bad >= end.piece, true)").select(key, F.col("end.piece").alias("last"), F.col("end.depth").alias("depth"))
    last = pieces.withColumnRenamed("piece", "last").join(ends, [key, "last"])
    closed = let(
        tree_tokens(F.col("text")),
        lambda t: let(
            token_count(t, F.col("depth")),
            lambda n: F.struct(n.alias("n"), token_spans(F.slice(t, F.lit(1), n), node_types).alias("spans")),
        ),
    )
    last = cut(last.select(key, "last", closed.alias("c")).where("c.n > 0").select(key, "last", F.col("c.spans").alias("end_spans")))

    inner = summed.where(F.size("spans") > 0).select(key, "piece", "spans").join(last.select(key, "last"), key).where("piece < last")
    every = inner.select(key, "piece", "spans").unionByName(last.where(F.size("end_spans") > 0).select(key, F.col("last").alias("piece"), F.col("end_spans").alias("spans")))
    in_order = F.array_sort(F.collect_list(F.struct("piece", "spans")))
    return every.groupBy(key).agg(F.flatten(F.transform(in_order, lambda p: p["spans"])).alias("spans"))


def extract_functions_in_pieces(
    entries: DataFrame,
    sources: DataFrame,
    trees: DataFrame,
    node_types: Sequence[str] = FUNCTION_NODE_TYPES,
    chars: int = PIECE_CHARS,
) -> DataFrame:
    """As ``extract_functions``, for trees too large for one task."""
    wanted = trees.join(entries.select(F.col("tree_path").alias("path")).distinct(), "path", "left_semi")
    spans = node_spans_in_pieces(wanted, node_types, "path", chars).withColumnRenamed("path", "tree_path")
    files = entries.join(sources.select("path", "content"), "path").join(spans, "tree_path").drop("tree_path")
    return explode_functions(functions_per_file(files, node_types, F.col("spans")).drop("spans"))
