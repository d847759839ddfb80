"""Near join by levels of pivots against brute force and the flat join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snippetlake.operators import nearjoin
from snippetlake.operators.components import connected_components
from snippetlake.operators.nearjoin import near_join
from snippetlake.operators.pivottree import near_join_tree, place_in_tree
from test_near_and_ward import T, blobs, brute, point_table

TREES = [
    {"fan_out": 4, "levels": 3, "always": True, "chunk": 16},
    {"fan_out": 2, "levels": 5, "always": True, "chunk": 40},
    {"fan_out": 8, "levels": 2, "chunk": 25},
    {"levels": 0, "chunk": 30},
]


@pytest.mark.parametrize("case", TREES)
@pytest.mark.parametrize("weighted", [False, True])
def test_modes(spark, case, weighted):
    x = blobs(3)
    w = np.random.default_rng(4).integers(1, 6, len(x))
    points = point_table(spark, x, w)
    pairs, d = brute(x, T, w.astype(float) if weighted else None)
    rows = near_join_tree(points, T, "pairs", weighted, **case).collect()
    assert len(rows) == len(pairs) and {(r.a, r.b) for r in rows} == pairs
    assert all(abs(r.distance - d[r.a, r.b]) < 1e-9 for r in rows)
    label = {r.node: r.component for r in connected_components(near_join_tree(points, T, "forest", weighted, **case)).collect()}
    flat = {r.node: r.component for r in connected_components(near_join(points, T, "forest", weighted)).collect()}
    assert label == flat
    best = [df.groupBy("id").agg(F.min(F.struct("height", "partner"))).collect() for df in (near_join_tree(points, T, "nearest", weighted, **case), near_join(points, T, "nearest", weighted))]
    assert sorted(best[0]) == sorted(best[1])


def test_three_levels_are_built_and_every_point_lives_once(spark):
    x = blobs(5, n=900, centres=60)
    rows = place_in_tree(point_table(spark, x), T, 16, fan_out=4, levels=3, always=True)
    lives = rows.where("role = 0").groupBy("id").count()
    assert lives.count() == len(x) and not lives.where("count > 1").count()
    assert rows.agg(F.max("cell")).first()[0] > 4 + 16


def test_equal_points_are_not_split(spark):
    x = np.tile(np.array([[0.6, 0.8]], "float32"), (90, 1))
    points = point_table(spark, x)
    assert place_in_tree(points, T, 16, fan_out=4, levels=3, always=True).select("cell").distinct().count() == 1
    assert near_join_tree(points, T, chunk=16).count() == 90 * 89 // 2


def test_no_points_and_no_partners(spark):
    points = point_table(spark, np.eye(5, dtype="float32"))
    assert near_join_tree(points, T, chunk=2, fan_out=2, levels=4, always=True).count() == 0
    assert near_join_tree(points.limit(0), T, chunk=2).count() == 0


def test_levels_beyond_64_bits_are_refused(spark):
    with pytest.raises(ValueError):
        place_in_tree(point_table(spark, np.eye(2, dtype="float32")), T, 2, fan_out=1 << 20, levels=5)


def test_crowded_cells_take_the_tree(spark, monkeypatch):
    x = blobs(6, n=400)
    monkeypatch.setattr(nearjoin, "CROWDED_CHUNKS", 1)
    pairs, _ = brute(x, T)
    assert {(r.a, r.b) for r in near_join(point_table(spark, x), T, chunk=20).collect()} == pairs
