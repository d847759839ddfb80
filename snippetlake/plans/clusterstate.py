"""Clusters kept up to date with a changing table of vectors.

Ward solves each component of the graph "height below the cut" alone, so after a change only components that
it can reach are solved again: those that lose, gain or re-weigh a point, and those whose ball (a member and the largest
distance from it) comes within the cut of a changed point. All others keep their rows, and their vectors
are not opened.

A folder holds append-only logs, partitioned by batch: ``vecs`` (also by a bucket of the component, so that
untouched buckets are not listed), ``places`` (the same points without vectors), ``clusters``, ``balls``,
``members``, and what a batch puts out of force: ``superseded`` components and ``gone`` vectors. A batch counts
once its row in ``commits`` exists. One writer at a time.

Defined cases: a vector id stands for one content for ever; zero vectors are members of no cluster; copies are one
weighted point; an update without changes writes nothing; the table may become empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import euclidean, l2_normalize
from ..operators.arrays import matrix
from ..operators.clusters import DEFAULT_MAX_DISTANCE, cluster_distances, digest
from ..operators.ward import cut_at, graph_components
from ..session import cut

BUCKETS = 32
#: Bytes of changed points that travel to every task; a larger change solves everything again.
BROADCAST_BYTES = 64 << 20
#: Added to the reach of a ball, far above the noise of its distances.
MARGIN = 1e-6
_KEY = "d1 bigint, d2 bigint"
_SCHEMAS = {
    "vecs": f"component bigint, id bigint, {_KEY}, weight bigint, vec array<float>, bucket int",
    "places": f"component bigint, id bigint, {_KEY}, weight bigint, cluster_id bigint",
    "clusters": "component bigint, cluster_id bigint, size bigint, first_merge_distance double, avg_distance double",
    "balls": "component bigint, centre array<float>, radius double",
    "members": f"vector_id bigint, {_KEY}, zero boolean",
    "superseded": "component bigint, old_batch_id bigint",
    "gone": "vector_id bigint",
    "commits": "max_distance double",
}


class ClusterState:
    """The clusters of a table of vectors at one cut."""

    def __init__(self, spark: SparkSession, path: str, max_distance: float = DEFAULT_MAX_DISTANCE):
        self.spark, self.path, self.max_distance = spark, path.rstrip("/"), max_distance

    # the logs

    def _all(self, part: str) -> DataFrame:
        schema = f"{_SCHEMAS[part]}, batch_id bigint"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], schema)
            raise

    def _next_batch(self) -> int:
        last, built = self._all("commits").agg(F.max("batch_id"), F.max("max_distance")).first()
        if built is not None and built != self.max_distance:
            raise ValueError(f"these clusters are cut at {built}, not at {self.max_distance}")
        return 0 if last is None else last + 1

    def _committed(self, part: str) -> DataFrame:
        log = self._all(part)
        return log.join(self._all("commits").select("batch_id"), "batch_id", "left_semi").select(*log.columns)

    def _in_force(self, part: str) -> DataFrame:
        old = self._committed("superseded").select("component", F.col("old_batch_id").alias("batch_id"))
        return self._committed(part).join(old, ["component", "batch_id"], "left_anti")

    def _held(self) -> DataFrame:
        """(vector_id, d1, d2, zero) of the vectors that the state has seen and that are not gone."""
        return self._committed("members").drop("batch_id").join(self._committed("gone").select("vector_id"), "vector_id", "left_anti")

    # the results

    def clusters(self) -> DataFrame:
        """``(cluster_id, size, first_merge_distance, avg_distance)`` of the clusters of more than one member."""
        return self._in_force("clusters").drop("component", "batch_id")

    def members(self) -> DataFrame:
        """``(cluster_id, vector_id)`` of the same clusters."""
        several = self._in_force("clusters").select("component", "cluster_id")
        owned = self._in_force("places").join(several, ["component", "cluster_id"], "left_semi").select("cluster_id", "d1", "d2")
        return self._held().filter("not zero").join(owned, ["d1", "d2"]).select("cluster_id", "vector_id")

    # the update

    def update(self, vectors: DataFrame, cap: int | None = None, chunk: int | None = None) -> dict:
        """Bring the clusters up to date with ``vectors (vector_id, embedding)``, the whole table as it is now;
        returns how many vectors came and went, and how many components and points were solved."""
        batch_id = self._next_batch()
        held = self._held()
        fresh = cut(vectors.select("vector_id").join(held.select("vector_id"), "vector_id", "left_anti"))
        gone = cut(held.join(vectors.select("vector_id"), "vector_id", "left_anti"))
        counts = {"added": fresh.count(), "removed": gone.count(), "components": 0, "points": 0}
        if not (counts["added"] or counts["removed"]):
            return counts
        unit = vectors.join(fresh, "vector_id", "left_semi").select("vector_id", l2_normalize(F.col("embedding")).alias("vec"))
        units = cut(unit.select("vector_id", "vec", *digest(F.col("vec"))).withColumn("zero", ~F.exists("vec", lambda x: x != 0)))
        changed = cut(units.filter("not zero").select("d1", "d2").unionByName(gone.filter("not zero").select("d1", "d2")).distinct())

        # the points of the changed contents, as they are now
        now = held.join(gone.select("vector_id"), "vector_id", "left_anti").unionByName(units.drop("vec"))
        weighed = now.join(changed, ["d1", "d2"], "left_semi").groupBy("d1", "d2").agg(F.min("vector_id").alias("id"), F.count("*").alias("weight"))
        places = self._in_force("places")
        was = cut(places.join(changed, ["d1", "d2"], "left_semi").select("component", "batch_id", "d1", "d2"))
        lost = was.select("component", "batch_id").distinct()
        known = units.filter("not zero").select("d1", "d2", "vec").unionByName(self._vecs(cut(lost)).select("d1", "d2", "vec").join(changed, ["d1", "d2"], "left_semi"))
        points = cut(weighed.join(known.groupBy("d1", "d2").agg(F.first("vec").alias("vec")), ["d1", "d2"]).select("id", "d1", "d2", "weight", "vec"))

        touched = cut(lost.unionByName(self._reached(points)).distinct())
        rest = self._vecs(touched).join(changed, ["d1", "d2"], "left_anti").select("id", "d1", "d2", "weight", "vec")
        todo = cut(rest.unionByName(points))
        counts |= {"components": touched.count(), "points": todo.count()}
        self._write(batch_id, self._solved(todo, cap, chunk), touched, units.drop("vec"), gone.select("vector_id"))
        return counts

    def _vecs(self, components: DataFrame) -> DataFrame:
        """Points with vectors of ``components (component, batch_id)``; only their buckets are opened."""
        # at most BUCKETS numbers
        buckets = [r[0] for r in components.select(_bucket()).distinct().collect()]
        return self._all("vecs").filter(F.col("bucket").isin(buckets)).join(components, ["component", "batch_id"], "left_semi")

    def _reached(self, points: DataFrame) -> DataFrame:
        """(component, batch_id) of the components whose ball comes within the cut of a point."""
        balls = self._in_force("balls")
        dim = points.select(F.size("vec")).first()
        n = points.count()
        if dim is None:
            return balls.select("component", "batch_id").limit(0)
        if n * dim[0] * 8 > BROADCAST_BYTES:
            return balls.select("component", "batch_id")
        shared = self.spark.sparkContext.broadcast(matrix(points.select("vec").toArrow()["vec"]))
        reach = self.max_distance + MARGIN

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = shared.value
            for batch in batches:
                c, radius = matrix(batch.column(2)), batch.column(3).to_numpy()
                hit = np.zeros(len(c), bool)
                for a in range(0, len(x), 4096):
                    part = x[a : a + 4096]
                    d2 = (c * c).sum(1)[:, None] + (part * part).sum(1)[None] - 2.0 * (c @ part.T)
                    hit |= (np.sqrt(np.maximum(d2, 0.0)) < (radius + reach)[:, None]).any(1)
                keep = batch.filter(pa.array(hit))
                yield pa.record_batch({"component": keep.column(0), "batch_id": keep.column(1)})

        return balls.select("component", "batch_id", "centre", "radius").mapInArrow(near, "component bigint, batch_id bigint")

    def _solved(self, points: DataFrame, cap: int | None, chunk: int | None) -> DataFrame:
        """Every point with its component, cluster and first merge."""
        t, options = self.max_distance, {} if cap is None else {"cap": cap}
        plain = points.select("id", "weight", "vec")
        nodes = graph_components(plain, t, chunk)
        owner = cut_at(plain, t, chunk=chunk, nodes=nodes, **options).select("id", "cluster_id", "leaf_height")
        named = points.join(nodes.withColumnRenamed("node", "id"), "id", "left").join(owner, "id", "left")
        return cut(
            named.select(
                F.coalesce("component", "id").alias("component"), "id", "d1", "d2", "weight", "vec",
                F.coalesce("cluster_id", "id").alias("cluster_id"), F.coalesce("leaf_height", F.lit(0.0)).alias("leaf_height"),
            )
        )

    def _write(self, batch_id: int, solved: DataFrame, touched: DataFrame, members: DataFrame, gone: DataFrame) -> None:
        sizes = solved.groupBy("component", "cluster_id").agg(F.sum("weight").alias("size")).filter("size > 1")
        rows = cut(solved.join(sizes, ["component", "cluster_id"]))
        found = cluster_distances(rows.select("cluster_id", "id", "size", "weight", "leaf_height", "vec"))
        centres = cut(solved.filter("id = component").select("component", F.col("vec").alias("centre")))
        # written first: a component with many points is then a plain exchange, which can be split
        far = solved.select("component", "vec").join(centres, "component").groupBy("component").agg(F.max(euclidean(F.col("vec"), F.col("centre"))).alias("radius"))
        tables = {
            "vecs": solved.withColumn("bucket", _bucket()).repartition("bucket"),
            "places": solved,
            "clusters": found.join(sizes.select("component", "cluster_id"), "cluster_id"),
            "balls": centres.join(far, "component"),
            "members": members,
            "superseded": touched.withColumnRenamed("batch_id", "old_batch_id"),
            "gone": gone,
            "commits": self.spark.range(1).select(F.lit(float(self.max_distance)).alias("max_distance")),
        }
        for part, table in tables.items():
            names = [x.split()[0] for x in _SCHEMAS[part].split(", ")]
            writer = table.select(*names).write.mode("overwrite")
            if part == "vecs":
                writer = writer.partitionBy("bucket")
            writer.parquet(f"{self.path}/{part}/batch_id={batch_id}")


def _bucket():
    return F.pmod(F.xxhash64("component"), F.lit(BUCKETS)).cast("int").alias("bucket")
