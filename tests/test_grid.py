"""Nearest neighbours over a grid of blocks: equal to brute force, in small blocks, with odd rows; clustered vectors skip blocks."""

import numpy as np
import pytest

from palimpsest.operators import dense, grid

Q, P = "query_id long, embedding array<double>, version int", "vec_id long, embedding array<double>, version_low int, version_high int"


def brute(queries, passages, k, filtered):
    out = set()
    ok = lambda e: e is not None and None not in e
    for q, e, v in queries:
        if not ok(e) or q is None:
            continue
        found = [(-round(float(np.dot(e, x)), 6), i) for i, x, lo, hi in passages if i is not None and ok(x) and len(x) == len(e) and (not filtered or None not in (v, lo, hi) and lo <= v <= hi)]
        out |= {(q, i, -s + 0.0, n) for n, (s, i) in enumerate(sorted(found)[:k], 1)}
    return out


def rows(seed, n, clusters, spread, width=8):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(clusters, width))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    own = np.round((centre[r.integers(0, clusters, n)] + spread * r.normal(size=(n, width))) * 64) / 64  # dyadic, so that sums are exact
    return [(i, v.tolist(), int(i % 5), int(i % 5 + i % 3)) for i, v in enumerate(own)]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("SAMPLE", 60), ("PIVOTS", 8), ("ROWS", 16), ("QUERY_ROWS", 8), ("STRIPE", 4), ("RUN", 2)):
        monkeypatch.setattr(grid, name, value)


def frames(spark, queries, passages):
    return spark.createDataFrame(queries, Q).repartition(3), spark.createDataFrame(passages, P).repartition(3)


@pytest.mark.parametrize("filtered", [False, True])
def test_grid_equals_brute_force(spark, small, filtered):
    passages = rows(1, 300, 6, 0.4) + [(900, None, 0, 9), (901, [1.0, None], 0, 9), (902, [1.0, 2.0], 0, 9), (903, [], 0, 9), (None, [1.0] * 8, 0, 9), (904, [1.0] * 8, None, 9), (905, [0.0] * 8, 0, 9)]
    queries = [(i, e, i % 7) for i, e, _, _ in rows(2, 70, 6, 0.4)] + [(800, [3.0, 4.0], 3), (801, None, 3), (802, [0.0] * 8, 3), (803, passages[5][1], None), (804, [1.0, 2.0, 3.0], 3), (None, [1.0] * 8, 3)]
    got = [tuple(r) for r in grid.top_k(*frames(spark, queries, passages), 5, filtered).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(queries, passages, 5, filtered)


def test_grid_and_broadcast_agree_on_ties(spark, small):
    """Copies of few vectors, so that most scores tie; more asked for than there is."""
    passages = [(i, [float(i % 3), 1.0], 0, 9) for i in range(100)]
    q, p = frames(spark, [(i, [1.0, float(i % 2)], 1) for i in range(20)], passages)
    for k in (7, 150):
        assert {tuple(r) for r in grid.top_k(q, p, k, False).collect()} == {tuple(r) for r in dense.top_k(q, p, k, False).collect()}


def test_clustered_vectors_skip_blocks(spark, small, monkeypatch):
    monkeypatch.setattr(grid, "PIVOTS", 40)  # so that some lie in every cluster
    passages = rows(3, 2000, 8, 0.03)
    q, p = frames(spark, [(i, e, 1) for i, e, _, _ in passages[:300]], passages)
    counts = grid.Counts(spark)
    got = {tuple(r) for r in grid.top_k(q, p, 5, False, counts=counts).collect()}
    assert got == brute([(i, e, 1) for i, e, _, _ in passages[:300]], passages, 5, False)
    assert 0 < counts.compared <= counts.met < counts.pairs / 2


def test_blocks_are_full_however_the_rows_come(spark, small):
    """Blocks were made by each task on its own: 30 tasks made 30 times as many, and pairs of blocks are their square."""
    passages = rows(5, 600, 6, 0.4)
    asked = [(i, e, i % 7) for i, e, _, _ in passages]
    found = []
    for parts in (1, 30):
        counts = grid.Counts(spark)
        q, p = (df.repartition(parts) for df in frames(spark, asked, passages))
        got = [tuple(r) for r in grid.top_k(q, p, 5, True, counts=counts).collect()]
        found.append((sorted(got), counts.pairs))
    assert found[0] == found[1] and set(found[0][0]) == brute(asked, passages, 5, True)
    assert counts.pairs <= 4 * (600 / 16) * (600 / 8)


def test_blocks_hold_vectors_that_single_precision_would_cut(spark, small):
    passages = [(i, [1 + i * 2.0**-40, 1e300 if i == 3 else 0.5], 0, 9) for i in range(40)]
    queries = [(i, [2.0**30, 0.0], 1) for i in range(3)]
    got = [tuple(r) for r in grid.top_k(*frames(spark, queries, passages), 5, True).collect()]
    assert set(got) == brute(queries, passages, 5, True)


def test_empty_tables(spark):
    q, p = frames(spark, [(1, [1.0], 1)], [(1, [1.0], 0, 9)])
    assert grid.top_k(q.limit(0), p, 3, False).count() == 0 and grid.top_k(q, p.limit(0), 3, False).count() == 0
    assert [tuple(r) for r in grid.top_k(q, p, 3, True).collect()] == [(1, 1, 1.0, 1)]


def test_many_queries_take_the_grid(spark, monkeypatch):
    passages = rows(4, 200, 4, 0.2)
    q, p = frames(spark, [(i, e, i % 7) for i, e, _, _ in passages[:40]], passages)
    few = {tuple(r) for r in dense.top_k(q, p, 3, True).collect()}
    asked = []
    whole = grid.top_k
    monkeypatch.setattr(grid, "top_k", lambda *a: asked.append(a) or whole(*a))
    monkeypatch.setattr(dense, "BLOCK", 39)
    assert {tuple(r) for r in dense.top_k(q, p, 3, True).collect()} == few and len(asked) == 1


@pytest.mark.parametrize("versions", [3, 40])
def test_tiles_are_walked_through_in_little_memory_and_keep_what_ties(versions, monkeypatch):
    """2,048 queries over 8,192 passages: their scores are 134 MB, and sorting a tile took several times its size; equal and missing numbers included."""
    import tracemalloc

    from palimpsest.operators import dense

    draw = np.random.default_rng(3)
    queries, vectors = draw.integers(-3, 4, (2048, 8)).astype(float), draw.integers(-3, 4, (8192, 8)).astype(float)
    vectors[5, 0], vectors[6] = np.nan, vectors[7]
    asked, low = draw.integers(0, versions, 2048), draw.integers(0, versions, 8192)
    high, unset, ids = low + draw.integers(0, 3, 8192), draw.random(2048) < 0.01, draw.permutation(8192)
    k, rows = 5, np.argsort(asked, kind="stable")
    score, found = np.full((2048, k), -np.inf), np.full((2048, k), -1)
    tracemalloc.start()
    dense.compare((queries, asked, unset), rows, (vectors, ids, low, high), score, found, True, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    for q in range(0, 2048, 7):
        fits = np.flatnonzero((low <= asked[q]) & (asked[q] <= high) & ~unset[q] & ~np.isnan(vectors[:, 0]))
        want = sorted((-s, i) for s, i in zip((vectors[fits] @ queries[q]).tolist(), ids[fits].tolist()))[:k]
        assert [(-s, i) for s, i in zip(score[q].tolist(), found[q].tolist()) if s > -np.inf] == want
