"""Encoders."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snippetlake.operators.encode import declared_dim, encode_texts, hash_encoder, model_encoder

TEXTS = ["a b a", "", "  \n ", "Ünï cödé X\ny x", "word " * 500, "one"]


def test_hash_encoder(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    rows = encode_texts(df, hash_encoder(64)).orderBy("i").collect()
    for text, row in zip(TEXTS, rows):
        v = np.zeros(64)
        for token, n in Counter(t for t in text.lower().replace("\n", " ").split(" ") if t).items():
            v[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 64] += n
        norm = np.linalg.norm(v)
        assert np.allclose(row.embedding, v / norm if norm else v, atol=1e-7)
    assert declared_dim(spark, hash_encoder(64)) == 64


def stub_encoder(dim):
    def load():  # a local function, so that workers need not import this module
        def predict(texts: np.ndarray) -> np.ndarray:
            return np.array([[len(t), 1.0, 0.0] for t in texts], dtype="float32")

        return predict

    return model_encoder("stub", dim, load, batch_size=2)


def test_model_encoder(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "")], "i int, text string").repartition(2)
    rows = encode_texts(df, stub_encoder(3)).orderBy("i").collect()
    assert np.allclose(rows[0].embedding, np.array([3, 1, 0]) / 10**0.5) and rows[1].embedding == [0.0, 1.0, 0.0]


def test_wrong_dimension_fails(spark):
    df = spark.createDataFrame([(1, "abc")], "i int, text string")
    with pytest.raises(Exception, match="declares 4 values, got 3"):
        encode_texts(df, stub_encoder(4)).collect()


def test_texts_are_encoded_once(spark):
    plan = encode_texts(spark.createDataFrame([(1, "a")], "i int, text string").filter(F.col("i") > 0), hash_encoder())
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1


def test_tokens_are_hashed_once_a_worker(spark, monkeypatch):
    """Odd texts as in the plain loop, a hash for each distinct token, and no step of the plan for every token."""
    from snippetlake.operators import encode

    seen, md5 = [], hashlib.md5
    monkeypatch.setattr(encode.hashlib, "md5", lambda token: seen.append(token) or md5(token))
    texts = ["a b a", None, "", "b  a\nb ", "\u00fcn\u00ef \x00 \t"]
    got = encode.token_counts(pa.array([None if t is None else t.encode() for t in texts], pa.binary()), 48).to_pylist()
    for text, counts in zip(texts, got):
        want = [0] * 48
        for token in (text or "").replace("\n", " ").split(" "):
            if token:
                want[int(md5(token.encode()).hexdigest()[:8], 16) % 48] += 1
        assert counts == want
    assert sorted(seen) == sorted({t.encode() for t in ("a", "b", "\u00fcn\u00ef", "\x00", "\t")})
    assert encode.token_counts(pa.array([], pa.binary()), 48).to_pylist() == []
    plan = encode_texts(spark.createDataFrame([(1, "a")], "i int, text string").filter(F.col("i") > 0), hash_encoder())
    assert "conv(" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_are_joined_by_their_hash_first(spark, tmp_path, monkeypatch):
    """A vector alone as a key is made anew for every comparison of a sort (F11)."""
    from snippetlake.plans import catalog

    docs = [(i, f"x{i % 3}\ny\n" * 4, "en", "s") for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(catalog, "_scratch", lambda spark, name: str(tmp_path / name))
    found = catalog.encode_once(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, ((hash#" in plan
    rows = found.collect()
    assert len({r.digest for r in rows}) == len(rows) and sum(r.functions for r in rows) > len(rows)


def test_tokens_are_looked_up_by_portion_and_vectors_come_in_unit_length(spark, monkeypatch):
    """The values of counting and ``l2_normalize`` to the last bit, however texts fall into portions, and without a
    lookup for each token or a step of the plan for each value (F19 to F22, F24)."""
    from snippetlake.functions.vectors import l2_normalize
    from snippetlake.operators import encode

    texts = [None, "", " \n ", *(" ".join(f"t{k % (i + 3)}" for k in range(7 * i)) for i in range(60)), "é \x00 \n x"]
    binary = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    asked = []
    monkeypatch.setattr(encode._Buckets, "of", lambda self, tokens, of=encode._Buckets.of: asked.extend(tokens) or of(self, tokens))
    whole = encode.token_vectors(binary, 32)
    assert len(asked) == len(set(asked)) < 70
    monkeypatch.setattr(encode, "PORTION_ROWS", 7)
    monkeypatch.setattr(encode, "PORTION_BYTES", 50)
    assert encode.token_vectors(binary, 32).equals(whole) and encode.token_vectors(binary.slice(5), 32).equals(whole.slice(5))
    rows = list(enumerate(encode.token_counts(binary, 32).to_pylist()))
    unit = spark.createDataFrame(rows, "i int, v array<float>").select("i", l2_normalize(F.col("v")).alias("v")).orderBy("i").collect()
    assert [r.v for r in unit] == whole.to_pylist()
    plan = encode_texts(spark.createDataFrame([(1, "a")], "i int, text string").filter(F.col("i") > 0), hash_encoder())
    assert "aggregate(" not in plan._jdf.queryExecution().optimizedPlan().toString()
