"""Text encoders. An encoder is a name, a dimension and a column function."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import l2_normalize
from ..session import cut
from ..sources.encodings import EncodingTable, text_digest

DEFAULT_BATCH_SIZE = 32
#: Tokens whose buckets a worker remembers.
KNOWN_TOKENS = 1 << 18
#: Texts, and bytes of text, whose tokens are counted at a time; one longer text is a portion of its own.
PORTION_ROWS, PORTION_BYTES = 1 << 12, 4 << 20


@dataclass(frozen=True)
class Encoder:
    """``encode`` maps a text column to an ``ARRAY<FLOAT>`` column of ``dim`` values.

    ``reuse``: encoding costs more than looking a vector up, so ingest keeps vectors by content.
    ``unit``: the vectors come with length 1 already (or 0).
    """

    name: str
    dim: int
    encode: Callable[[Column], Column]
    reuse: bool = False
    unit: bool = False


class _Buckets(dict):
    """Hash bucket of a token by its bytes: the first 32 bits of its MD5, modulo ``buckets``. The empty token has a
    bucket of its own after the others."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[b""] = self.buckets

    def of(self, tokens: list[bytes]) -> np.ndarray:
        """Buckets of distinct tokens."""
        found, md5 = np.fromiter(map(self.get, tokens, itertools.repeat(-1)), "int64", len(tokens)), hashlib.md5
        at = np.flatnonzero(found < 0)
        fresh = [tokens[i] for i in at.tolist()]
        found[at] = np.frombuffer(b"".join([md5(t).digest()[:4] for t in fresh]), ">u4") % self.buckets
        self.update(zip(fresh, found[at].tolist()))
        return found


#: Kept from batch to batch in a worker, since most tokens come again.
_known = functools.cache(_Buckets)


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts that make up a portion."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64"))
    start = 0
    while start < len(texts):
        room = (ends[start - 1] if start else 0) + PORTION_BYTES
        stop = max(start + 1, min(start + PORTION_ROWS, int(np.searchsorted(ends, room, side="right"))))
        yield start, stop
        start = stop


def _counts(texts: pa.Array, buckets: int) -> np.ndarray:
    """Counts per bucket of the space-separated tokens of each binary text; none of a null one. Distinct tokens of a
    portion are looked up, the others follow them by number."""
    known, counts = _known(buckets), np.zeros((len(texts), buckets), "float32")
    for start, stop in _portions(texts):
        part = pc.replace_substring(pc.fill_null(texts.slice(start, stop - start), b""), b"\n", b" ")
        lists = pc.split_pattern(part, b" ")
        tokens = lists.flatten().dictionary_encode()
        bucket = known.of(tokens.dictionary.to_numpy(zero_copy_only=False).tolist())[tokens.indices.to_numpy()]
        row = np.repeat(np.arange(stop - start), pc.list_value_length(lists).to_numpy())
        held = np.bincount(row * (buckets + 1) + bucket, minlength=(stop - start) * (buckets + 1))
        counts[start:stop] = held.reshape(stop - start, buckets + 1)[:, :buckets]
        if len(known) > KNOWN_TOKENS:
            known.forget()
    return counts


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype="int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def token_counts(texts: pa.Array, buckets: int) -> pa.Array:
    """Dense counts per bucket of the space-separated tokens of each binary text; none of a null one."""
    return _lists(_counts(texts, buckets))


def token_vectors(texts: pa.Array, buckets: int) -> pa.Array:
    """The counts as unit vectors, with the values that ``l2_normalize`` gives: sums of squares of counts are exact."""
    counts = _counts(texts, buckets)
    for start in range(0, len(counts), PORTION_ROWS):
        part = counts[start : start + PORTION_ROWS]
        exact = part.astype("float64")
        norm = np.sqrt(np.einsum("ij,ij->i", exact, exact))[:, None]
        part[:] = exact / np.where(norm == 0, 1.0, norm)
    return _lists(counts)


def hash_encoder(buckets: int = 256) -> Encoder:
    """Token counts hashed to ``buckets`` places, as unit vectors; needs no model."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors_by_md5(texts: pa.Array) -> pa.Array:
        return token_vectors(texts, buckets)

    def encode(text: Column) -> Column:
        return vectors_by_md5(F.lower(text).cast("binary"))

    return Encoder(f"token-hash-{buckets}", buckets, encode, unit=True)


def model_encoder(name: str, dim: int, make_predict_fn: Callable, batch_size: int = DEFAULT_BATCH_SIZE) -> Encoder:
    """Any model: ``make_predict_fn`` loads it once per Python worker and returns a
    function from a batch of texts to a float matrix."""
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return Encoder(name, dim, predict, reuse=True)


def encode_texts(df: DataFrame, encoder: Encoder, text: str = "text", out: str = "embedding") -> DataFrame:
    """Replace ``text`` by its unit vector; a vector of another length fails the job."""
    rest = [c for c in df.columns if c != text]
    raw = df.select(*rest, encoder.encode(F.col(text)).alias(out))
    wrong = F.concat(F.lit(f"encoder {encoder.name} declares {encoder.dim} values, got "), F.size(out).cast("string"))
    checked = F.when(F.size(out) == encoder.dim, F.col(out)).otherwise(F.raise_error(wrong).cast("array<float>"))
    found = raw.select(*rest, checked.alias(out))
    return found if encoder.unit else found.select(*rest, l2_normalize(F.col(out)).alias(out))


def encode_once(df: DataFrame, encoder: Encoder, table: EncodingTable, key: str, text: str = "text", out: str = "embedding") -> DataFrame:
    """As ``encode_texts``, but only texts that ``table`` has no vector of are encoded, each distinct one
    once, and added to it. ``key`` is unique in ``df``, which should be cheap to read twice.

    Digests are compared on narrow rows; a text moves only if it is the one to be encoded. Copies
    combine before the shuffle, and the last join has plain sides, so a text that a third of the rows share
    can be split.
    """
    rest = [c for c in df.columns if c != text]
    named = cut(df.select(*rest, text_digest(F.col(text)).alias("_digest")))
    first = named.groupBy("_digest").agg(F.min(key).alias(key))
    known = table.vectors(encoder.name).select(F.col("digest").alias("_digest"))
    new = cut(first.join(known, "_digest", "left_anti"))
    if not new.isEmpty():
        texts = df.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)).join(new, key)
        # spread again: the join may have dealt few large partitions, and encoding is the costly part
        spreaded = texts.select(F.col("_digest").alias("digest"), text).repartition("digest")
        table.append(encoder.name, encode_texts(spreaded, encoder, text, "embedding"))
    vectors = table.vectors(encoder.name).select(F.col("digest").alias("_digest"), F.col("embedding").alias(out))
    return named.join(vectors, "_digest").select(*rest, out)


def declared_dim(spark, encoder: Encoder) -> int:
    """Dimension found by encoding one dummy text; raises if it is not the declared one."""
    dim = encode_texts(spark.createDataFrame([("dummy",)], "text string"), encoder).select(F.size("embedding")).first()[0]
    return dim
