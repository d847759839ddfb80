"""Near join, components, Ward cut and cluster reports against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snippetlake.operators import clusters as C
from snippetlake.operators import numbering, ward
from snippetlake.operators.components import connected_components
from snippetlake.operators import nearjoin
from snippetlake.operators.nearjoin import Cells, choose_cells, chunk_rows, near_join
from snippetlake.operators.numbering import with_offsets
from snippetlake.operators.report import cluster_report
from snippetlake.operators.ward import ward_clusters
from snippetlake.session import cut

T = 0.35


def blobs(seed, n=260, d=12, centres=25, spread=0.06):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    share = np.r_[0.4, np.full(centres - 1, 0.6 / (centres - 1))]  # one crowded place
    x = c[rng.choice(centres, n, p=share)] + rng.normal(size=(n, d)) * spread
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")
    x[rng.choice(n, n // 8, replace=False)] = x[rng.choice(n, n // 8)]  # exact copies
    return x


def point_table(spark, x, weights=None):
    w = np.ones(len(x), int) if weights is None else weights
    return cut(spark.createDataFrame([(i, int(w[i]), x[i].tolist()) for i in range(len(x))], "id long, weight long, vec array<float>"))


def brute(x, t, w=None):
    x = x.astype("float64")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    if w is not None:
        d = d * np.sqrt(2.0 * w[:, None] * w[None] / (w[:, None] + w[None]))
    return {(i, j) for i, j in np.argwhere(d < t) if i < j}, d


CUTS = [{}, {"chunk": 40}, {"pivots": 6}, {"pivots": 9, "chunk": 25}, {"pivots": 40, "chunk": 16}]


def options(case, x, t):
    out = {k: v for k, v in case.items() if k == "chunk"}
    if "pivots" in case:
        out["cells"] = Cells(np.unique(x.astype("float64"), axis=0)[: case["pivots"]], t)
    return out


@pytest.mark.parametrize("case", CUTS)
@pytest.mark.parametrize("weighted", [False, True])
def test_near_join_modes(spark, case, weighted):
    x = blobs(1)
    w = np.random.default_rng(2).integers(1, 6, len(x))
    points = point_table(spark, x, w)
    pairs, d = brute(x, T, w.astype(float) if weighted else None)
    opts = {"weighted": weighted, **options(case, x, T)}
    rows = near_join(points, T, "pairs", **opts).collect()
    assert len(rows) == len(pairs) and {(r.a, r.b) for r in rows} == pairs
    assert all(abs(r.distance - d[r.a, r.b]) < 1e-12 for r in rows)

    label = {r.node: r.component for r in connected_components(near_join(points, T, "forest", **opts)).collect()}
    assert label == reachable(pairs)

    best = near_join(points, T, "nearest", **opts).groupBy("id").agg(F.min(F.struct("h2", "partner")).alias("b")).collect()
    off = np.where(np.eye(len(x), dtype=bool), np.inf, d)
    assert {r.id for r in best} == {int(i) for i in np.nonzero(off.min(1) < T)[0]}
    assert all(abs(r.b.h2**0.5 - off[r.id].min()) < 1e-9 for r in best)


def reachable(pairs):
    label = {n: n for p in pairs for n in p}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return {int(k): int(v) for k, v in label.items()}


def test_choice_of_pivots_is_bounded_and_exact(spark):
    x = blobs(3, n=900, centres=60)
    points = point_table(spark, x)
    cells = choose_cells(points, T, 900, 50)
    rows = near_join(points, T, "pairs", chunk=50).collect()
    assert {(r.a, r.b) for r in rows} == brute(x, T)[0]
    assert 1 <= len(cells.pivots) <= 900


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(5, 3), (3, 9), (7, 8)]])
def test_components_of_shapes(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == reachable({e for e in edges if e[0] != e[1]})


def naive_ward(x, t):
    """Merge the least pair until the cut; returns labels and, per cluster of more than one
    member, the mean of the heights of merges that join its first member, still alone, with
    another lone member (0 if there is none)."""
    x = x.astype("float64")
    groups = {i: [i] for i in range(len(x))}
    heights = {}
    while len(groups) > 1:
        keys = sorted(groups)
        c = np.array([x[groups[k]].mean(0) for k in keys])
        w = np.array([len(groups[k]) for k in keys], float)
        h = np.sqrt(2 * w[:, None] * w[None] / (w[:, None] + w[None])) * np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
        h[np.tril_indices(len(keys))] = np.inf
        i, j = np.unravel_index(h.argmin(), h.shape)
        if not h[i, j] < t:
            break
        a, b = keys[i], keys[j]
        if len(groups[a]) == len(groups[b]) == 1:
            heights[a] = heights[b] = h[i, j]
        groups[a] = sorted(groups[a] + groups.pop(b))
    found = {k: g for k, g in groups.items() if len(g) > 1}
    return found, {k: heights.get(k, 0.0) for k in found}


@pytest.mark.parametrize("how", [{}, {"cap": 0, "chunk": 30}, {"cap": 8, "chunk": 64}, {"levels": [0.08, 0.2]}, {"cap": 8, "levels": [0.15]}])
def test_clusters_equal_naive_ward(spark, how):
    x = blobs(11, n=150, d=10, centres=20, spread=0.07)
    found, first = naive_ward(x, T)
    rows = [(i, f"/f{i}.py", i % 3, (x[i] * 3).tolist()) for i in range(len(x))] + [(900, "/zero.py", 0, [0.0] * 10)]
    table = spark.createDataFrame(rows, "vector_id long, path string, line int, embedding array<float>")
    clusters, members = C.find_clusters(table, T, **how)
    got = {}
    for r in members.collect():
        got.setdefault(r.cluster_id, []).append(r.vector_id)
    assert {k: sorted(v) for k, v in got.items()} == found
    rows = {r.cluster_id: r for r in clusters.collect()}
    assert set(rows) == set(found)
    for k, g in found.items():
        mean = np.sqrt(((x[g[1:]].astype("float64") - x[k]) ** 2).sum(1)).mean()
        assert rows[k].size == len(g)
        assert abs(rows[k].avg_distance - mean) < 1e-6
        assert abs(rows[k].first_merge_distance - first[k]) < 1e-6, (k, g)
    assert any(len(g) > 3 for g in found.values())
    assert any(v > 0 for v in first.values()) and any(v == 0 for v in first.values())


def ordered_ward(x, t):
    """Merge the pair of least (height rounded to 9 places, lo, hi) until the cut."""
    groups = {i: [i] for i in range(len(x))}
    while True:
        pairs = []
        for a in groups:
            for b in groups:
                if a < b:
                    wa, wb = len(groups[a]), len(groups[b])
                    h = np.sqrt(2 * wa * wb / (wa + wb)) * np.linalg.norm(x[groups[a]].mean(0) - x[groups[b]].mean(0))
                    pairs.append((round(h, 9), a, b))
        if not pairs or not min(pairs)[0] < t:
            return {i: k for k, g in groups.items() for i in g}
        _, a, b = min(pairs)
        groups[a] += groups.pop(b)


@pytest.mark.parametrize("how", [{}, {"cap": 6, "chunk": 7}, {"levels": [0.1, 0.15]}])
def test_tied_distances_fall_alike_on_all_routes(spark, how):
    x = np.array([[0.1 * i, 0.1 * j, 0.7] for i in range(4) for j in range(4)])[np.random.default_rng(5).permutation(16)]
    points = cut(spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "id long, weight long, vec array<double>"))
    assert {r.id: r.cluster_id for r in ward_clusters(points, 0.25, **how).collect()} == ordered_ward(x, 0.25)


def test_ward_leaves_far_points_alone(spark):
    points = point_table(spark, np.eye(4, dtype="float32"))
    assert {(r.id, r.cluster_id) for r in ward_clusters(points, 0.5).collect()} == {(i, i) for i in range(4)}
    assert ward_clusters(point_table(spark, np.eye(4, dtype="float32")[:1]), 0.5).count() == 1


def test_cluster_filters_and_report(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near_b = [0.1, 1.0, 0.0]
    vecs = {1: a, 2: b, 3: a, 4: near_b, 5: c, 6: c, 7: c}
    table = spark.createDataFrame([(i, f"/f{i}.py", 1, v) for i, v in vecs.items()], "vector_id long, path string, line int, embedding array<float>")
    text = {1: "x\none\ntwo\n", 2: "x\nb1\n\n  b2\n", 3: "x\none\ntwo", 4: "x\nonly", 5: "x\nc\nc\nc", 6: "x\nc\nc\nc", 7: "x\nc\nc\nc"}
    sources = spark.createDataFrame([(f"/f{i}.py", t) for i, t in text.items() if i != 3], "path string, content string")
    found = C.find_clusters(table, 0.3)

    def kept(**how):
        numbered, _ = C.filter_clusters(*found, sources, **how)
        return [(r.cluster_no, r.cluster_id, r.size) for r in numbered.orderBy("cluster_no").collect()]

    assert kept(ignore_identical=False) == [(0, 1, 2), (1, 2, 2), (2, 5, 3)]
    assert kept() == kept(compat=False) == [(0, 2, 2)]
    assert kept(ignore_identical=False, min_cluster_size=3) == [(0, 5, 3)]
    assert kept(ignore_identical=False, min_lines=1) == [(0, 5, 3)]  # /f3 has a one-line placeholder
    rows = cluster_report(*C.filter_clusters(*found, sources)).orderBy("cluster_no", "vector_id").collect()
    d = np.sqrt(((np.array(near_b) / np.linalg.norm(near_b) - np.array(b)) ** 2).sum())
    assert [r.text for r in rows] == [
        f"Cluster #0: avg_distance: {d:.3} " + "=" * 48 + "\n",
        "    /f2.py:1\n    b1\n\n      b2\n",
        "    /f4.py:1\n    only\n",
    ]
    lost = C.filter_clusters(*found, sources, ignore_identical=False)[1].filter("vector_id = 3").first()
    assert lost.text == "# Could not read file: /f3.py"


def test_offsets_equal_running_sum(spark):
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 5, 3000)
    names = [f"p{v:05d}" for v in rng.permutation(3000)]
    df = spark.createDataFrame(list(zip(names, counts.tolist())), "path string, n int").repartition(6)
    got = {r.path: r.offset for r in with_offsets(df, "path", "n", start=7).collect()}
    total = 7
    for name, n in sorted(zip(names, counts.tolist())):
        assert got[name] == total
        total += n
    few = with_offsets(df.limit(3), "path").orderBy("path").collect()
    assert [r.offset for r in few] == [0, 1, 2]


@pytest.mark.parametrize("broadcast", [True, False])
def test_offsets_over_a_tree_of_ranges(spark, monkeypatch, broadcast):
    """Three levels of four ranges, also where split points and totals are joined by range; no leaf is large."""
    if not broadcast:
        monkeypatch.setattr(numbering, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(numbering, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(1)
    # most names share a prefix, a few lie far off
    names = [f"long/prefix/{v:06d}" for v in rng.permutation(3000)] + ["a", "b", "z", "zz"]
    counts = rng.integers(0, 5, len(names)).tolist()
    df = spark.createDataFrame(list(zip(names, counts)), "path string, n int").repartition(6)
    seen = []
    carried = numbering._carried
    monkeypatch.setattr(numbering, "_carried", lambda totals, levels, fan_out: seen.append((levels, totals.count())) or carried(totals, levels, fan_out))
    got = {r.path: r.offset for r in with_offsets(df, "path", "n", 7, fan_out=4, leaf_rows=40).collect()}
    total = 7
    for name, n in sorted(zip(names, counts)):
        assert got[name] == total
        total += n
    assert seen[0][0] == 3 and 48 <= seen[0][1] <= 64


def crowd(n, arms):
    """One point and ``n`` others around it, each on an axis of its own (of ``arms``), no two alike."""
    x = np.full((n + 1, arms), 0.05)
    x[np.arange(1, n + 1), np.arange(n) % arms] += 0.1 + 0.01 * np.random.default_rng(5).random(n)
    return x


def test_solver_takes_a_crowd_in_by_chains(monkeypatch):
    """The same merges as by rounds of mutual pairs, of which each would take one point in."""
    x, ids = crowd(150, 150), np.arange(151)
    chained = ward.solve_component(ids, np.ones(151, int), x, 0.2)
    monkeypatch.setattr(ward, "STALLED", 0)
    monkeypatch.setattr(ward, "AT_ONCE", 1000)
    rounds = ward.solve_component(ids, np.ones(151, int), x, 0.2)
    kept = rounds[0] == ids
    for k, (a, b) in enumerate(zip(chained, rounds)):
        assert np.array_equal(a[kept], b[kept]) if k == 3 else np.array_equal(a, b)
    assert (rounds[5] > 0).sum() > 100


def test_bounds_leave_what_others_may_change():
    x = np.array([[0.0], [1.0], [2.5], [10.0]])
    free = ward.solve_component(np.arange(4), np.ones(4, int), x, 5.0)
    assert free[0].tolist() == [0, 0, 0, 3]
    held = ward.solve_component(np.arange(4), np.ones(4, int), x, 5.0, np.array([9.0, 1.2, 9.0, 9.0]))
    assert held[0].tolist() == [0, 0, 2, 3]


def test_rounds_solve_a_crowd_in_groups(spark, monkeypatch):
    """A crowd beyond what a task takes ends after few rounds, with the merges of the solver."""
    x = crowd(120, 120)
    rows = [(0, i, 1, v.tolist()) for i, v in enumerate(x)]
    members = spark.createDataFrame(rows, "component long, id long, weight long, vec array<double>")
    joins = []
    plain = ward.near_join
    monkeypatch.setattr(ward, "near_join", lambda *a, **k: joins.append(1) or plain(*a, **k))
    got = ward.merge_rounds(members, 0.2, cap=10, group=60).toPandas().sort_values("id")
    want = ward.solve_component(np.arange(len(x)), np.ones(len(x), int), x, 0.2)
    assert got["cluster_id"].tolist() == want[0].tolist()
    assert got["into"].fillna(-1).astype(int).tolist() == want[4].tolist()
    np.testing.assert_allclose(got["height"].fillna(0), want[5], atol=1e-9)
    np.testing.assert_allclose(got["leaf_height"], want[1], atol=1e-9)
    assert len(joins) < 20


def test_small_chunks_grow_with_the_table(spark):
    """A crowded cell ships a row once per chunk, so there are 32 chunks of a table at most while memory allows."""
    points = spark.createDataFrame([(1, [0.0] * 64)], "id long, vec array<float>")
    assert [chunk_rows(points, n, 64) for n in (10, 2048, 6400, 102_400)] == [64, 64, 200, 3200]
    assert chunk_rows(points, 10**9, 64) == nearjoin.CHUNK_BYTES // (8 * 64)


def test_more_pivots_on_larger_tables(spark):
    x = np.random.default_rng(5).normal(size=(3000, 4)).astype("float32")
    points = point_table(spark, x)
    few, many = (nearjoin._sample(points, n, 4, 8192) for n in (3000, 1_000_000))
    assert len(few) == 2 * nearjoin.TEST_ROWS and len(many) == nearjoin.TEST_ROWS + 2000


@pytest.mark.parametrize("scale", [1.0, 1e-7, 1e25])
@pytest.mark.parametrize("weighted", [False, True])
def test_single_precision_only_names_candidates(scale, weighted):
    """Copies, pairs at the threshold and lengths whose squares are beyond single precision, in sparse and crowded blocks."""
    rng = np.random.default_rng(3)
    for spread in (1.0, 1e-4):
        x = rng.normal(size=(90, 8)) * spread + 1.0
        x[80:] = x[:10]
        x *= scale
        side = lambda rows: nearjoin._Side(pa.table({"id": rows, "weight": 1 + rows % 3, "vec": pa.array(list(x[rows]), pa.list_(pa.float64()))}))
        left, right = side(np.arange(50)), side(np.arange(50, 90))
        ids = np.arange(90)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        if weighted:
            d = d * np.sqrt(nearjoin.ward_factor(1.0 + ids[:, None] % 3, 1.0 + ids[None] % 3))
        d[50:] = np.inf  # rows of left with one another and with right
        d[ids[:, None] >= ids[None]] = np.inf
        for t in (np.quantile(d[np.isfinite(d)], q) for q in (0.01, 0.2, 0.9)):
            found = nearjoin._pairs(left, right, True, weighted, t)
            assert set(zip(found["a"].to_pylist(), found["b"].to_pylist())) == {(i, j) for i, j in np.argwhere(d < t)}
            best = nearjoin._nearest(left, right, True, weighted, t)
            least = np.minimum(d, d.T).min(1)
            got = dict(zip(best["id"].to_pylist(), best["h2"].to_pylist()))
            assert set(got) == set(np.flatnonzero(least < t)) and np.allclose(np.sqrt([got[i] for i in sorted(got)]), least[least < t])


def test_solver_keeps_the_nearest_of_every_cluster(monkeypatch):
    """F1 to F3, F5, F6: a crowded component is looked through a few times, not once for every round of merges; lists that
    run out, ties and bounds give the merges that chains give."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 24)) * 0.02 + rng.normal(size=(6, 24))[rng.integers(0, 6, 700)] * 0.02
    x[:90] = np.round(x[:90], 2)  # ties
    ids, w, bound = np.arange(700), rng.integers(1, 4, 700), np.where(rng.random(700) < 0.1, 0.12, np.inf)
    compared = []
    distances = ward.squared_distances
    monkeypatch.setattr(ward, "squared_distances", lambda a, b: compared.append(len(a) * len(b)) or distances(a, b))
    for limits in (None, bound):
        monkeypatch.setattr(ward, "LOOKS", -1)
        chained = ward.solve_component(ids, w, x, 0.4, limits)
        monkeypatch.setattr(ward, "LOOKS", 10**6)
        compared.clear()
        kept = ward.solve_component(ids, w, x, 0.4, limits)
        assert sum(compared) < 5 * 700**2
        monkeypatch.setattr(ward, "NEAREST", 2)
        short = ward.solve_component(ids, w, x, 0.4, limits)
        monkeypatch.setattr(ward, "NEAREST", 24)
        for other in (kept, short):
            assert np.array_equal(other[0], chained[0]) and np.array_equal(other[4], chained[4])
            assert all(np.allclose(a, b) for a, b in zip(other, chained))


def test_near_join_along_main_directions_first(monkeypatch):
    """F1 to F3, F5, F6: long vectors are told apart by a few products; the pairs are those of all places."""
    monkeypatch.setattr(nearjoin, "FLAT_FROM", 1)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 128))
    x = centres[rng.integers(0, 60, 500)] + rng.normal(size=(500, 128)) * rng.uniform(0.001, 0.04, (500, 1))
    side = lambda rows: nearjoin._Side(pa.table({"id": rows, "weight": rows * 0 + 1, "vec": pa.array(list(x[rows]), pa.list_(pa.float64()))}))
    widths = []
    products = nearjoin._products
    monkeypatch.setattr(nearjoin, "_products", lambda left, *rest: widths.append(left.x.shape[1]) or products(left, *rest))
    found = nearjoin._pairs(side(np.arange(300)), side(np.arange(300, 500)), True, False, 0.3)
    want = {(i, j) for i, j in brute(x, 0.3)[0] if i < 300}
    assert len(want) > 100 and set(zip(found["a"].to_pylist(), found["b"].to_pylist())) == want
    assert set(widths) == {nearjoin.FLAT}


def test_near_join_ships_blocks(spark):
    """F1 to F3, F5, F6: a group is shuffled as a few blocks, not as a row for every copy of a vector."""
    x = blobs(3, n=600, d=8)
    points = point_table(spark, x).coalesce(1)
    cells = nearjoin._count_cells(points, Cells(np.unique(x.astype("float64"), axis=0)[:5], T), 100)
    blocks = nearjoin._place_copies(points, cells).select("cell", "l", "r", "role", "n").collect()
    assert len(blocks) == len({b[:4] for b in blocks}) < 300 < sum(b.n for b in blocks)
