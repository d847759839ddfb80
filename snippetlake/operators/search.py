"""Exact cosine top-k for one query or a table of queries.

Vectors and queries are unit vectors, so a score is a dot product. Each task keeps the
best ``k`` per query of what it has read, with one matrix product per Arrow batch; only
those rows are shuffled. Filters come first, so only surviving vectors are scored.
Scores are compared after rounding to nine decimals and ties go to the lower
``vector_id``: copies of a text tie exactly, and the order in which a processor adds
must not decide between them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.paths import file_ext
from .arrays import matrix

DEFAULT_K = 5
SCORE_DECIMALS = 9
#: queries up to this many and this many bytes travel to every task; more visit cells of vectors
BROADCAST_QUERIES = 4096
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 8192
_SCORES_AT_ONCE = 1 << 22


def restrict(
    vectors: DataFrame,
    files: DataFrame | None = None,
    extensions: Sequence[str] | None = None,
    functions: DataFrame | None = None,
) -> DataFrame:
    """Vectors of the given files AND extensions, and, given a function listing, only
    those it holds. An empty extension list means no filter; so does ``files=None``."""
    out = vectors
    if extensions:
        wanted = sorted({e.lstrip(".").lower() for e in extensions})
        out = out.filter(file_ext(F.col("path")).isin(wanted))
    if files is not None and not files.isEmpty():
        out = out.join(files.select("path").distinct(), "path", "left_semi")
    if functions is not None:
        out = out.join(functions.select("vector_id"), "vector_id", "left_semi")
    return out


def _best(query: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best ``k`` rows of each query, by score, then key."""
    order = np.lexsort((key, -score, query))
    q = query[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - start < k]


class Leaders:
    """Running best ``k`` rows per query of one task."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, schema: pa.Schema):
        self.ids, self.q, self.k, self.schema = ids, queries.astype("float64").T, k, schema
        self.floor = np.full(len(ids), -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]] = []
        self.held = 0

    def add(self, batch: pa.Table, vec: str) -> None:
        step = max(1, _SCORES_AT_ONCE // max(1, len(self.ids)))
        for at in range(0, batch.num_rows, step):
            self._add(batch.slice(at, step), vec)

    def _add(self, rows: pa.Table, vec: str) -> None:
        scores = matrix(rows[vec]) @ self.q
        keys = np.round(scores, SCORE_DECIMALS)
        if len(keys) > self.k:
            kth = np.partition(keys, len(keys) - self.k, axis=0)[len(keys) - self.k]
            self.floor = np.maximum(self.floor, kth)
        r, q = np.nonzero(keys >= self.floor)
        if len(r) == 0:
            return
        self.parts.append((q, keys[r, q], scores[r, q], rows.drop_columns([vec]).take(pa.array(r))))
        self.held += len(r)
        if self.held > 4 * self.k * len(self.ids) + 4096:
            self.compact()

    def compact(self) -> None:
        q, key, score = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        rows = pa.concat_tables([p[3] for p in self.parts])
        keep = _best(q, key, rows["vector_id"].to_numpy(), self.k)
        q, key, score, rows = q[keep], key[keep], score[keep], rows.take(pa.array(keep))
        counts = np.bincount(q, minlength=len(self.ids))
        last = np.cumsum(counts) - 1
        full = counts >= self.k
        self.floor[full] = np.maximum(self.floor[full], key[last[full]])
        self.parts, self.held = [(q, key, score, rows)], len(q)

    def result(self) -> pa.Table | None:
        if not self.parts:
            return None
        self.compact()
        q, key, score, rows = self.parts[0]
        head = [pa.array(self.ids[q], pa.int64()), pa.array(key, pa.float64()), pa.array(score, pa.float64())]
        body = [c.cast(f.type) for c, f in zip(rows.columns, list(self.schema)[len(head) :])]
        return pa.Table.from_arrays(head + body, schema=self.schema)


def _rank(candidates: DataFrame, k: int, payload: list[str]) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("rank_key"), F.col("vector_id"))
    return (
        candidates.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "score", *payload)
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, max_broadcast: int = BROADCAST_QUERIES) -> DataFrame:
    """``(query_id, rank, score, vector_id, …)``: the best ``k`` vectors of each query.

    ``vectors`` carries ``vector_id``, ``embedding`` and whatever columns should come
    back; ``queries`` carries ``query_id`` and ``embedding``. Ranks start at 1; a query
    gets fewer rows only if fewer vectors exist.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    payload = [c for c in vectors.columns if c != "embedding"]
    fields = [T.StructField("query_id", T.LongType()), T.StructField("rank_key", T.DoubleType()), T.StructField("score", T.DoubleType())]
    out = T.StructType(fields + [vectors.schema[c] for c in payload])
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    head = asked.limit(max_broadcast + 1).toArrow()
    if head.num_rows <= max_broadcast and head.nbytes <= BROADCAST_BYTES:
        return _rank(_scan(vectors, head, k, payload, out), k, payload)
    from .cellsearch import build_cells, top_k_cells

    return top_k_cells(build_cells(vectors), asked, k)


def _scan(vectors: DataFrame, head: pa.Table, k: int, payload: list[str], out: T.StructType) -> DataFrame:
    """Few queries: every task gets them all and reads its share of the vectors once."""
    if head.num_rows == 0:
        return vectors.sparkSession.createDataFrame([], out)
    shared = vectors.sparkSession.sparkContext.broadcast((head["query_id"].to_numpy(), matrix(head["embedding"])))
    schema = to_arrow_schema(out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        leaders = Leaders(ids, q, k, schema)
        for batch in batches:
            leaders.add(pa.Table.from_batches([batch]), "embedding")
        best = leaders.result()
        if best is not None:
            yield from best.to_batches()

    return vectors.select(*payload, "embedding").mapInArrow(scan, out)


def text_queries(queries: DataFrame, encoder) -> DataFrame:
    """``(query_id, embedding)`` of the query texts that are not blank."""
    from .encode import encode_texts

    asked = queries.filter(F.length(F.trim(F.translate("text", "\n\t\r", "   "))) > 0)
    return encode_texts(asked.select("query_id", "text"), encoder)
