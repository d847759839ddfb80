"""Change plan of a stream against hand-made sequences of versions."""

import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from snippetlake.session import shared_dir
from snippetlake.streaming import change_stream, changes

SCHEMA = "path string, md5 string, seconds double"


@pytest.fixture
def feed(spark):
    base = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"

    def send(rows):
        """Land rows and start the query anew; returns what all starts gave."""
        made = spark.createDataFrame(rows, SCHEMA).select("path", "md5", F.timestamp_micros((F.col("seconds") * 1e6).cast("long")).alias("mtime"))
        made.write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(made.schema).parquet(f"{base}/in")
        sink = change_stream(arriving).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress")
        sink.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path, r.md5, r.micros, r.status, r.version) for r in spark.read.parquet(f"{base}/out").collect())

    return send


def test_versions_out_of_order_and_a_restart(feed):
    first = feed([("a", "x", 10.0), ("b", "x", 10.0), ("c", "old", 5.0), ("c", "new", 9.0), (None, "x", 1.0), ("d", None, 1.0), ("e", "x", None)])
    assert first == [("a", "x", 10_000_000, "new", 1), ("b", "x", 10_000_000, "new", 1), ("c", "new", 9_000_000, "new", 1)]
    second = feed([("a", "y", 12.0), ("b", "x", 10.05), ("c", "old", 5.0)])
    assert second == sorted(first + [("a", "y", 12_000_000, "changed", 2), ("b", "x", 10_050_000, "unchanged", 1), ("c", "old", 5_000_000, "late", 1)])
    third = feed([("a", "x", 11.0), ("b", "x", 10.12), ("c", "other", 9.0)])
    # b drifted by 0.05 s twice, and counts from the time in force
    assert sorted(set(third) - set(second)) == [("a", "x", 11_000_000, "late", 2), ("b", "x", 10_120_000, "changed", 2), ("c", "other", 9_000_000, "changed", 2)]


def test_a_hot_path_is_folded_to_one_row(feed):
    rows = [("hot", f"{i:05d}", 1.0 + i % 7) for i in range(30_000)] + [("cold", "x", 1.0)]
    last = max(digest for path, digest, seconds in rows if seconds == 7.0)
    assert feed(rows) == [("cold", "x", 1_000_000, "new", 1), ("hot", last, 7_000_000, "new", 1)]


def test_paths_that_share_a_state(feed, monkeypatch):
    """All paths in one bucket: each keeps its own fingerprint, and one call judges all that arrive."""
    monkeypatch.setattr(changes, "BUCKETS", 1)
    first = feed([(f"p{i}", f"x{i}", 10.0 + i) for i in range(50)])
    assert sorted(r[3:] for r in first) == [("new", 1)] * 50
    second = feed([(f"p{i}", "y" if i % 2 else f"x{i}", 70.0) for i in range(40)] + [("q", "z", 1.0)])
    assert sorted(r[3:] for r in set(second) - set(first)) == [("changed", 2)] * 40 + [("new", 1)]
    third = feed([(f"p{i}", "late", 9.0) for i in range(50)])
    assert {r[0]: r[3:] for r in set(third) - set(second)} == {f"p{i}": ("late", 2 if i < 40 else 1) for i in range(50)}


def test_one_call_for_many_paths():
    """The function that Spark calls for a key takes every path that arrived under it."""

    class State:
        exists, kept = False, None

        def update(self, value):
            self.kept = value

    frames = [pd.DataFrame({"path": ["a", "b", "a"], "md5": ["1", "2", "3"], "micros": [5, 6, 4]})] * 2
    state = State()
    rows = pd.concat(changes._judge((0,), iter(frames), state))
    assert rows.values.tolist() == [["a", "1", 5, "new", 1], ["b", "2", 6, "new", 1]]
    assert state.kept == (["a", "b"], ["1", "2"], [5, 6], [1, 1])
