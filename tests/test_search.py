"""Top-k against a full ranking."""

import numpy as np
import pytest

from snippetlake.operators.encode import hash_encoder
from snippetlake.operators.search import restrict, text_queries, top_k


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = unit(rng, 600, 16)
    x[100:140] = x[3]  # forty copies tie exactly
    q = unit(rng, 30, 16)
    q[0] = x[3]
    ext = ["py", "JS", "go"]
    rows = [(i, f"/s{i % 4}/f{i}.{ext[i % 3]}", i % 7, x[i].tolist()) for i in range(len(x))]
    vectors = spark.createDataFrame(rows, "vector_id long, path string, line int, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, q[i].tolist()) for i in range(len(q))], "query_id long, embedding array<float>")
    return vectors, queries, rows, x.astype("float64"), q.astype("float64")


def ranking(data, k, keep=lambda row: True):
    _, _, rows, x, q = data
    ids = [i for i, r in enumerate(rows) if keep(r)]
    out = []
    for j in range(len(q)):
        scores = np.round(x[ids] @ q[j], 9)
        best = sorted(zip(-scores, ids))[:k]
        out += [(j, rank, i) for rank, (_, i) in enumerate(best, 1)]
    return out


def found(hits):
    return [(r.query_id, r["rank"], r.vector_id) for r in hits.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("k", [1, 5, 41, 1000])
def test_both_routes_equal_full_ranking(data, k):
    vectors, queries = data[:2]
    assert found(top_k(vectors, queries, k)) == ranking(data, k)
    assert found(top_k(vectors, queries, k, max_broadcast=3)) == ranking(data, k)


def test_block_route_with_many_blocks(data, monkeypatch):
    from snippetlake.operators import search

    monkeypatch.setattr(search, "BLOCK_ROWS", 50)
    assert found(top_k(*data[:2], 5, max_broadcast=0)) == ranking(data, 5)


def test_filters_equal_filtered_ranking(spark, data):
    vectors, queries = data[:2]
    files = spark.createDataFrame([(f"/s1/f{i}.JS",) for i in range(600)], "path string")
    assert found(top_k(restrict(vectors, extensions=[".Js", "py"]), queries, 7)) == ranking(data, 7, lambda r: r[1].lower()[-2:] in ("js", "py"))
    assert found(top_k(restrict(vectors, files=files), queries, 7)) == ranking(data, 7, lambda r: r[1].startswith("/s1/") and r[1].endswith("JS"))
    both = restrict(vectors, files=files, extensions=["go"])
    assert top_k(both, queries, 7).count() == 0
    nothing = files.filter("false")
    assert found(top_k(restrict(vectors, files=nothing, extensions=[]), queries, 3)) == ranking(data, 3)
    live = vectors.filter("vector_id % 2 = 0").select("vector_id")
    assert found(top_k(restrict(vectors, functions=live), queries, 3)) == ranking(data, 3, lambda r: r[0] % 2 == 0)


def test_edges(spark, data):
    vectors, queries = data[:2]
    with pytest.raises(ValueError):
        top_k(vectors, queries, 0)
    assert top_k(vectors, queries.filter("false"), 5).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, " \n\t"), (3, "word")], "query_id long, text string")
    assert [r.query_id for r in text_queries(blank, hash_encoder()).collect()] == [3]


def test_filter_runs_before_scoring(data):
    plan = restrict(data[0], extensions=["py"]).select("vector_id", "embedding")
    hits = top_k(plan, data[1], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert hits.index("MapInArrow") < hits.rindex("Filter ")


def scaled(x, ids=None):
    return [(int(i), v.tolist(), f"p{i}") for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)]


def best_of(x, q, k):
    keys = np.round(x @ q.T, 9)
    return [(j, r, i) for j in range(len(q)) for r, (_, i) in enumerate(sorted(zip(-keys[:, j], range(len(x))))[:k], 1)]


@pytest.mark.parametrize(("kind", "share"), [("clustered", 0.3), ("noise", 1.0), ("crowded", 1.0), ("lengths", 1.0)])
def test_cells_equal_full_ranking(spark, monkeypatch, kind, share):
    from snippetlake.operators import search
    from snippetlake.operators.cellsearch import Work, build_cells, top_k_cells

    monkeypatch.setattr(search, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(9)
    x = unit(rng, 900, 12)
    if kind in ("clustered", "crowded"):
        centres = unit(rng, 30, 12)
        place = rng.choice(30, 900, p=np.r_[0.5, np.full(29, 0.5 / 29)]) if kind == "crowded" else rng.integers(0, 30, 900)
        x = centres[place] + rng.normal(size=(900, 12)) * 0.03
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")
    if kind == "lengths":
        x = (x * rng.uniform(0, 5, (900, 1))).astype("float32")
        x[:3] = 0
    x[50:90] = x[7]  # forty copies tie exactly
    q = x[rng.choice(900, 200, replace=False)].copy()
    q[0] = 0
    vectors = spark.createDataFrame(scaled(x), "vector_id long, embedding array<float>, path string").repartition(4)
    queries = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(q)], "query_id long, embedding array<float>")
    work = Work()
    hits = top_k_cells(build_cells(vectors, 60), queries, 5, work)
    assert found(hits) == best_of(x.astype("float64"), q.astype("float64"), 5)
    assert work.pairs == 900 * 200 and work.scored <= share * work.pairs + 1200  # the zero query reaches every cell
    assert all(r.path == f"p{r.vector_id}" for r in hits.collect())


def test_cells_of_odd_tables(spark):
    from snippetlake.operators.cellsearch import build_cells, top_k_cells

    vectors = spark.createDataFrame(scaled(np.eye(3)[[0, 0, 1]]), "vector_id long, embedding array<float>, path string")
    queries = spark.createDataFrame([(4, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    assert found(top_k_cells(build_cells(vectors, 50), queries, 9)) == [(4, 1, 0), (4, 2, 1), (4, 3, 2)]
    assert top_k_cells(build_cells(vectors.limit(0)), queries, 2).count() == 0
    assert top_k_cells(build_cells(vectors), queries.limit(0), 2).count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        top_k_cells(build_cells(vectors), queries, 0)


def test_vectors_are_shipped_for_few_blocks_of_queries():
    """A cell's vectors go to every block of queries that visits it (F8, F13); a block stays within its bytes."""
    from snippetlake.operators import search
    from snippetlake.operators.cellsearch import QUERY_BYTES, _block_rows

    assert _block_rows(64) == _block_rows(256) == 4 * search.BLOCK_ROWS
    assert search.BLOCK_ROWS < _block_rows(512) <= QUERY_BYTES // (8 * 512)
    assert _block_rows(4096) == search.BLOCK_ROWS


def test_queries_are_shipped_once_for_a_shelf():
    """F4, F8: neighbouring cells share a shelf, so a query that visits all of 40 cells is shipped for 5 shelves and not
    for 40 cells; a crowded cell takes several."""
    from snippetlake.operators.cellsearch import CellIndex, _Calls, make_shelves

    rng = np.random.default_rng(2)
    centres, rows = unit(rng, 40, 8).astype("float64"), np.full(40, 100)
    shelves = make_shelves(centres, rows, 800)
    assert len(set(shelves.first.tolist())) == 5 and shelves.words == 1
    index = CellIndex(None, centres, np.full(40, 2.0), np.ones(40), rows)
    calls = _Calls(index, shelves, unit(rng, 30, 8).astype("float64"), np.full(30, np.nan), 0, 40)
    assert len(calls.cell) == 30 * 40 and len(calls.shelf) == 30 * 5
    assert sum(int(b).bit_count() for b in calls.bits.ravel()) == 30 * 40
    rows[7] = 2000
    crowded = make_shelves(centres, rows, 800)
    assert crowded.parts[7] == 3 and crowded.parts.sum() == 42
    held = np.zeros(int((crowded.first + crowded.parts).max()))
    np.add.at(held, crowded.first, np.where(crowded.parts > 1, 0, rows))
    assert held.max() <= 800
