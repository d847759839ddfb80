"""Incremental table: upserts, retries, readers, streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from snippetlake.operators.encode import encode_once, encode_texts, hash_encoder, model_encoder
from snippetlake.operators.maintenance import list_functions, orphans, prune_orphans, vector_ids_of_files, vectors_by_id
from snippetlake.plans.cluster import cluster
from snippetlake.plans.ingest import ingest, ingest_manifest, remove_files, upsert
from snippetlake.plans.query import search, search_text
from snippetlake.sources.store import ModelMismatch, StoreNotFound, VectorStore
from snippetlake.streaming import ingest_stream

FILES = "path string, content string, md5 string, mtime timestamp, tree string"
TREE = "(module (function_definition [0, 0] - [0, 9]) (function_definition [1, 0] - [1, 9]))"
ONE = "(module (function_definition [0, 0] - [0, 9]))"
NONE = "(module)"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def files(spark, *rows):
    full = [(p, c, f"md5 of {c}", at(s), t) for p, c, s, t in rows]
    return spark.createDataFrame(full, FILES)


def view(store):
    return sorted((r.path, r.ord, r.line, r.vector_id) for r in store.vectors().collect())


@pytest.fixture
def store(spark, tmp_path):
    return VectorStore(spark, str(tmp_path / "store"))


ENC = hash_encoder(32)


def test_life_of_a_table(spark, store):
    assert not store.exists()
    with pytest.raises(StoreNotFound):
        store.vectors()
    v1 = files(spark, ("/a", "x\ny", 0, TREE), ("/b", "u\nv", 0, TREE), ("/c", "w", 0, NONE), ("/d", "q", 0, None), ("/e", "e", 0, ONE))
    assert upsert(store, v1, ENC) == {"new": 5, "replaced": 0, "deleted": 0, "functions": 5}
    assert view(store) == [("/a", 0, 0, 0), ("/a", 1, 1, 1), ("/b", 0, 0, 2), ("/b", 1, 1, 3), ("/e", 0, 0, 4)]
    records = {r.path: r for r in store.files().collect()}
    assert records["/a"].vector_ids == [0, 1] and records["/a"].function_lines == [0, 1]
    assert records["/c"].vector_ids == [] and records["/c"].md5 is not None
    assert records["/d"].md5 is None  # no tree: tried again next time

    again = upsert(store, v1.filter("path <> '/d'"), ENC)
    assert again == {"new": 0, "replaced": 0, "deleted": 0, "functions": 0}

    v2 = files(spark, ("/a", "x\nz", 9, TREE), ("/b", "u\nv", 0.05, TREE), ("/c", "w", 0, NONE), ("/d", "q", 0, ONE), ("/e", "e", 60, NONE))
    assert upsert(store, v2, ENC) == {"new": 0, "replaced": 3, "deleted": 0, "functions": 3}
    assert view(store) == [("/a", 0, 0, 5), ("/a", 1, 1, 6), ("/b", 0, 0, 2), ("/b", 1, 1, 3), ("/d", 0, 0, 7)]

    assert upsert(store, v2, ENC, force=True)["replaced"] == 5
    gone = upsert(store, v2.filter("path in ('/a', '/d')"), ENC, prune_deleted=True)
    assert gone["deleted"] == 3 and {r[0] for r in view(store)} == {"/a", "/d"}
    before = view(store)
    assert store.compact() == 1 and view(store) == before
    assert store.head().replaced_files == 0 and sorted(r.vector_id for r in store.functions().collect()) == [r[3] for r in before]
    assert upsert(store, files(spark, ("/z", "new", 0, ONE)), ENC)["functions"] == 1
    assert max(r[3] for r in view(store)) == store.head().next_vector_id - 1


def test_uncommitted_batch_is_invisible_and_retried(spark, store, monkeypatch):
    upsert(store, files(spark, ("/a", "x", 0, ONE)), ENC)
    v2 = files(spark, ("/a", "y", 9, ONE), ("/b", "z", 0, ONE))
    real = VectorStore.write_batch

    def dies(self, generation, batch_id, records, vectors, superseded, commit):
        vectors.write.mode("overwrite").parquet(f"{self.path}/vectors/generation={generation}/batch_id={batch_id}")
        raise RuntimeError("lost")

    monkeypatch.setattr(VectorStore, "write_batch", dies)
    with pytest.raises(RuntimeError):
        upsert(store, v2, ENC)
    assert view(store) == [("/a", 0, 0, 0)]
    monkeypatch.setattr(VectorStore, "write_batch", real)
    upsert(store, v2, ENC, tag="job:1")
    done = view(store)
    assert done == [("/a", 0, 0, 1), ("/b", 0, 0, 2)]
    assert upsert(store, files(spark, ("/c", "z", 0, ONE)), ENC, tag="job:1") is None and view(store) == done


def test_model_change(spark, store):
    upsert(store, files(spark, ("/a", "x", 0, ONE), ("/b", "y", 0, ONE)), ENC)
    other = hash_encoder(16)
    with pytest.raises(ModelMismatch):
        search_text(store, "x", other, spark.createDataFrame([], "path string, content string"))
    upsert(store, files(spark, ("/b", "y", 0, ONE)), other)
    head = store.head()
    assert (head.generation, head.model_name, head.dim) == (1, other.name, 16)
    assert view(store) == [("/b", 0, 0, 0)]


def test_search_and_cluster_over_a_table(spark, store):
    rows = [(f"/p/{n}.py", text, 0, ONE) for n, text in enumerate(["alpha beta", "alpha beta gamma", "delta", "alpha beta", "delta epsilon zeta"])]
    table = files(spark, *rows)
    entries = table.select("path", F.concat("path", F.lit(".t")).alias("tree_path"))
    trees = entries.select(F.col("tree_path").alias("path"), F.lit(ONE).alias("tree"))
    sources = table.select("path", "content", "md5", "mtime")
    ingest(store, entries.union(entries), sources, trees, ENC)
    doc = search_text(store, "alpha beta", ENC, sources, k=2).first().markdown
    assert doc == (
        "# Search Results\n\n## Result 1 (score: 1.000)\n**File:** `/p/0.py:1`\n\n```python:1:1\nalpha beta\n```\n"
        "\n## Result 2 (score: 1.000)\n**File:** `/p/3.py:1`\n\n```python:1:1\nalpha beta\n```\n"
    )
    gap = search_text(store, "alpha beta", ENC, sources.filter("path <> '/p/0.py'"), k=2).first().markdown
    assert "## Result 2" in gap and "## Result 1 " not in gap
    assert search_text(store, "alpha", ENC, sources, extensions=["go"]).first().markdown == "# Search Results\n"
    with pytest.raises(ValueError):
        search_text(store, "  ", ENC, sources)
    many = spark.createDataFrame([(i, "delta") for i in range(3)], "query_id long, text string")
    assert search(store, many, ENC, k=1).select("path").distinct().first().path == "/p/2.py"
    texts = [r.text for r in cluster(store, ENC, sources, 0.1, ignore_identical=False).orderBy("cluster_no", "vector_id").collect()]
    assert texts[0].startswith("Cluster #0: avg_distance: 0.0 ") and len(texts) == 3


def test_cluster_builds_a_missing_table(spark, store):
    table = files(spark, ("/a.py", "same", 0, ONE), ("/b.py", "same", 0, ONE))
    with pytest.raises(StoreNotFound):
        cluster(store, ENC, table)
    report = cluster(store, ENC, table, build=lambda: upsert(store, table, ENC), ignore_identical=False)
    assert report.count() == 3


def test_stream_equals_batches(spark, store, tmp_path):
    landing = str(tmp_path / "landing")
    versions = [
        files(spark, ("/a", "x\ny", 0, TREE), ("/b", "u", 0, ONE)),
        files(spark, ("/a", "x\nz", 5, TREE), ("/a", "older", 3, ONE), ("/c", "w", 0, ONE)),
    ]
    for v in versions:
        v.coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(FILES).parquet(landing)
        ingest_stream(stream, store, ENC, str(tmp_path / "progress"), name="files").awaitTermination()
    assert [(p, o, n) for p, o, n, _ in view(store)] == [("/a", 0, 0), ("/a", 1, 1), ("/b", 0, 0), ("/c", 0, 0)]
    done = view(store)
    stream = spark.readStream.schema(FILES).parquet(landing)  # progress lost: tags keep it harmless
    ingest_stream(stream, store, ENC, str(tmp_path / "other"), name="files").awaitTermination()
    assert view(store) == done


def test_maintenance(spark):
    records = spark.createDataFrame([("/a", [1, 2, 3], [0, 5]), ("/b", [9], [1, 2]), ("/c", [], [])], "path string, vector_ids array<bigint>, function_lines array<int>")
    functions = list_functions(records)
    assert sorted(map(tuple, functions.collect())) == [("/a", 0, 1), ("/a", 5, 2), ("/b", 1, 9)]
    vectors = spark.createDataFrame([(i, [float(i)]) for i in (1, 2, 3, 9)], "vector_id long, embedding array<float>")
    assert [r.vector_id for r in orphans(vectors, functions).collect()] == [3]
    assert sorted(r.vector_id for r in prune_orphans(vectors, functions).collect()) == [1, 2, 9]
    ids = spark.createDataFrame([(2,), (2,), (77,)], "vector_id long")
    assert [r.vector_id for r in vectors_by_id(vectors, ids).collect()] == [2]
    paths = spark.createDataFrame([("/a",), ("/x",)], "path string")
    assert sorted(r.vector_id for r in vector_ids_of_files(functions, paths).collect()) == [1, 2]


def test_fingerprint_rules(spark):
    from snippetlake.operators.changes import same_fingerprint

    base = at(100)
    cases = [
        ("m", base, "m", base, True),
        ("m", base + dt.timedelta(microseconds=100_000), "m", base, True),
        ("m", base - dt.timedelta(microseconds=100_001), "m", base, False),
        ("n", base, "m", base, False),
        ("m", base, None, None, False),
        ("n", base, None, base, True),
        ("m", at(7), "m", None, True),
        ("m", None, "m", base, False),
        (None, base, "m", base, False),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, m string, t timestamp, om string, ot timestamp")
    got = df.select("i", same_fingerprint(F.col("m"), F.col("t"), F.col("om"), F.col("ot")).alias("same")).orderBy("i").collect()
    assert [r.same for r in got] == [c[4] for c in cases]


def test_vectors_are_unit(spark, store):
    upsert(store, files(spark, ("/a", "x y\nz", 0, TREE)), ENC)
    norms = [np.linalg.norm(r.embedding) for r in store.vectors().collect()]
    assert np.allclose(norms, 1.0)


def counting_encoder(log, name="counting"):
    """Writes down every text it is asked for; local mode, so the folder is shared."""

    def load():
        import uuid

        def predict(texts):
            with open(f"{log}/{uuid.uuid4().hex}", "w") as out:
                out.writelines(f"{t}\x00" for t in texts)
            return np.array([[len(t), 1.0, 2.0] for t in texts], dtype="float32")

        return predict

    return model_encoder(name, 3, load, batch_size=4)


def asked(log):
    found = sorted(t for f in log.iterdir() for t in f.read_text().split("\x00")[:-1])
    for f in log.iterdir():
        f.unlink()
    return found


def test_each_text_is_encoded_once(spark, store, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    enc = counting_encoder(log)
    assert enc.reuse and not hash_encoder().reuse
    upsert(store, files(spark, ("/a", "x\ny", 0, TREE), ("/b", "x\nx", 0, TREE), ("/c", "w", 0, ONE)), enc)
    assert asked(log) == ["w", "x", "y"]
    # renamed, moved, edited and copied
    upsert(store, files(spark, ("/moved", "x\ny", 9, TREE), ("/c", "w\nq", 9, TREE), ("/copy", "w", 9, ONE)), enc)
    assert asked(log) == ["q"]
    got = {(r.path, r.ord): r.embedding for r in store.vectors().collect()}
    one = got["/a", 0]
    assert len(got) == 9 and all(got[k] == one for k in (("/b", 0), ("/b", 1), ("/moved", 0), ("/c", 0), ("/copy", 0)))
    # another model encodes anew, the first one finds its vectors again
    upsert(store, files(spark, ("/a", "x", 20, ONE)), counting_encoder(log, "second"))
    assert asked(log) == ["x"]
    upsert(store, files(spark, ("/a", "x\ny", 30, TREE), ("/n", "new", 30, ONE)), enc)
    assert asked(log) == ["new"] and store.head().generation == 2


def test_encode_once_of_odd_rows(spark, tmp_path):
    from snippetlake.sources.encodings import EncodingTable

    enc, table = hash_encoder(16), EncodingTable(spark, str(tmp_path / "encodings"))
    rows = [(1, "a b", "p"), (2, None, "q"), (3, "", "r"), (4, "a b", "s"), (5, "B a", "t")]
    df = spark.createDataFrame(rows, "k long, text string, digest string")
    got = {r.k: (r.digest, r.embedding) for r in encode_once(df, enc, table, "k").collect()}
    plain = {r.k: r.embedding for r in encode_texts(df.na.fill("", ["text"]), enc).collect()}
    assert {k: v[1] for k, v in got.items()} == plain and got[4][0] == "s"
    assert sorted(r.texts for r in table.commits(enc.name).collect()) == [3]
    # what an interrupted batch left is not seen, and the next batch takes its place
    (tmp_path / "encodings/commits").rename(tmp_path / "lost")
    assert table.vectors(enc.name).count() == 0
    assert encode_once(df, enc, table, "k").count() == 5 and table.vectors(enc.name).count() == 3
    assert encode_once(df.limit(0), enc, table, "k").count() == 0 and table.commits(enc.name).count() == 1


def test_digests_move_and_texts_stay(spark, tmp_path):
    """Once every text is known, no text is shuffled."""
    from snippetlake.sources.encodings import EncodingTable

    enc, table = hash_encoder(16), EncodingTable(spark, str(tmp_path / "encodings"))
    df = spark.createDataFrame([(i, f"t{i % 5}") for i in range(50)], "k long, text string")
    encode_once(df, enc, table, "k").count()
    plan = encode_once(df, enc, table, "k")._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan


def test_removed_files(spark, store):
    upsert(store, files(spark, ("/p/a", "x\ny", 0, TREE), ("/q/a", "u", 0, ONE), ("/p/none", "v", 0, NONE)), ENC)
    named = spark.createDataFrame([("/p/a",), ("/q/a",), ("/p/none",), ("/p/strange",), ("/p/a",)], "path string")
    assert remove_files(store, named, "/p/") == 2
    assert view(store) == [("/q/a", 0, 0, 2)] and [r.path for r in store.files().collect()] == ["/q/a"]
    assert remove_files(store, named, "/p/") == 0
    assert upsert(store, files(spark, ("/p/a", "x", 0, ONE)), ENC)["new"] == 1 and len(view(store)) == 2


@pytest.mark.parametrize(("own", "used"), [('"model_name": "token-hash-16", "batch_size": 7,', ("token-hash-16", 7)), ("", ("token-hash-8", 32))])
def test_manifest_chooses_the_model(spark, store, tmp_path, own, used):
    from snippetlake.sources.manifest import read_manifest_json

    (tmp_path / "m.json").write_text('{%s "files": [{"path": "a", "tree_sitter_file": "a.tree"}, {"path": ""}]}' % own)
    sources = spark.createDataFrame([("/r/a", "x y", "m", at(0))], "path string, content string, md5 string, mtime timestamp")
    trees = spark.createDataFrame([("/r/a.tree", ONE)], "path string, tree string")
    asked = []

    def encoders(name, batch_size):
        asked.append((name, batch_size))
        return hash_encoder(int(name.rsplit("-", 1)[1]))

    counts = ingest_manifest(store, read_manifest_json(spark, str(tmp_path / "m.json")), "/r", sources, trees, encoders, "token-hash-8")
    assert asked == [used] and counts["functions"] == 1 and store.head().model_name == used[0]
