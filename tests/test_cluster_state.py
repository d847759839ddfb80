"""Clusters kept up to date against clustering anew."""

import numpy as np
import pytest
from test_near_and_ward import blobs

from snippetlake.operators import clusters as C
from snippetlake.operators.encode import hash_encoder
from snippetlake.plans.cluster import kept_clusters
from snippetlake.plans.clusterstate import ClusterState
from snippetlake.plans.ingest import remove_files, upsert
from snippetlake.sources.store import VectorStore
from test_store import ONE, TREE, files

T = 0.35


def table(spark, rows):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in rows.items()], "vector_id long, embedding array<float>")


def found(clusters, members):
    rows = sorted((r.cluster_id, r.size, round(r.first_merge_distance, 9), round(r.avg_distance, 9)) for r in clusters.collect())
    return rows, sorted((r.cluster_id, r.vector_id) for r in members.collect())


def test_updates_equal_a_full_run(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = blobs(21, n=220, d=8, centres=30, spread=0.07)
    now = {i: x[i] for i in range(150)} | {1000: np.zeros(8)}
    state = ClusterState(spark, str(tmp_path / "state"), T)
    steps = [{}]
    steps.append({"add": {i: x[i] for i in range(150, 170)}})
    steps.append({"drop": rng.choice(150, 12, replace=False).tolist()})
    # copies of one vector come and go, so weights rise and fall
    steps.append({"add": {2000 + i: x[160] for i in range(4)}, "drop": [160]})
    steps.append({"add": {i: x[i] for i in range(170, 220)}, "drop": [2000, 2001, 2002, 1000]})
    for step in steps:
        now |= step.get("add", {})
        for i in step.get("drop", []):
            now.pop(i, None)
        state.update(table(spark, now))
        assert found(state.clusters(), state.members()) == found(*C.find_clusters(table(spark, now), T))
    assert state.update(table(spark, now)) == {"added": 0, "removed": 0, "components": 0, "points": 0}
    state.update(table(spark, {5: x[5]}).limit(0))
    assert found(state.clusters(), state.members()) == ([], [])


def separate(n):
    """Groups of three near points, each group far from the others."""
    eye = np.eye(n)
    return {3 * g + k: eye[g] + 0.05 * k * eye[(g + 1) % n] for g in range(n) for k in range(3)}


def test_untouched_components_are_not_opened(spark, tmp_path):
    rows = separate(24)
    state = ClusterState(spark, str(tmp_path / "state"), T)
    assert state.update(table(spark, rows))["points"] == 72
    buckets = {r.component: r.bucket for r in state._all("vecs").select("component", "bucket").distinct().collect()}
    assert len(buckets) == 24 and len(set(buckets.values())) > 4
    for folder in (tmp_path / "state/vecs/batch_id=0").glob("bucket=*"):
        if folder.name != f"bucket={buckets[6]}":
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"not a table")  # opening it would fail
    near = rows[6] + 0.02 * np.eye(24)[9]
    assert state.update(table(spark, rows | {500: near})) == {"added": 1, "removed": 0, "components": 1, "points": 4}
    assert {(r.cluster_id, r.size) for r in state.clusters().collect()} == {(3 * g, 3 + (g == 2)) for g in range(24)}


def test_batches_without_commit_are_not_seen(spark, tmp_path):
    rows = separate(6)
    state = ClusterState(spark, str(tmp_path / "state"), T)
    state.update(table(spark, rows))
    before = found(state.clusters(), state.members())
    rows[100] = rows[0]
    state.update(table(spark, rows))
    after = found(state.clusters(), state.members())
    (tmp_path / "state/commits/batch_id=1").rename(tmp_path / "lost")
    assert found(state.clusters(), state.members()) == before != after
    state.update(table(spark, rows))
    assert found(state.clusters(), state.members()) == after
    with pytest.raises(ValueError, match="cut at"):
        ClusterState(spark, str(tmp_path / "state"), 0.1).update(table(spark, rows))


def test_clusters_of_a_store(spark, tmp_path):
    store, enc = VectorStore(spark, str(tmp_path / "store")), hash_encoder(64)
    upsert(store, files(spark, ("/a", "p q r\np q r", 0, TREE), ("/b", "p q r s", 0, ONE), ("/c", "z", 0, ONE)), enc)
    vectors = lambda: store.vectors().select("vector_id", "embedding")
    state = kept_clusters(store, enc, T)
    assert found(state.clusters(), state.members()) == found(*C.find_clusters(vectors(), T))
    upsert(store, files(spark, ("/a", "p q r\nz", 5, TREE), ("/n", "z", 0, ONE)), enc)
    remove_files(store, spark.createDataFrame([("/b",)], "path string"))
    state = kept_clusters(store, enc, T)
    assert found(state.clusters(), state.members()) == found(*C.find_clusters(vectors(), T))
    assert {r.size for r in state.clusters().collect()} == {3}
