"""Search over a stored table, from query texts to markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.context import with_snippets
from ..operators.encode import Encoder
from ..operators.report import search_markdown
from ..operators.search import DEFAULT_K, restrict, text_queries, top_k
from ..sources.store import VectorStore


def search(store: VectorStore, queries: DataFrame, encoder: Encoder, k: int = DEFAULT_K, files: DataFrame | None = None, extensions: Sequence[str] | None = None) -> DataFrame:
    """Hits of every query text ``(query_id, text)``; raises if the table is missing or
    was built with another encoder."""
    store.check_model(encoder)
    vectors = store.vectors().select("vector_id", "path", "line", "embedding")
    return top_k(restrict(vectors, files, extensions), text_queries(queries, encoder), k)


def search_text(store: VectorStore, text: str, encoder: Encoder, sources: DataFrame, **options) -> DataFrame:
    """One query as a markdown document in a one-row table."""
    if not text.strip():
        raise ValueError("the query text is empty")
    queries = store.spark.createDataFrame([(0, text)], "query_id long, text string")
    hits = search(store, queries, encoder, **options)
    return search_markdown(with_snippets(hits, sources), queries).select(F.col("markdown"))
