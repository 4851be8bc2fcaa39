"""The index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neighbours as N

SCHEMA = "chunk_id long, embedding array<float>, query long, similarity string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in rows], SCHEMA)


def brute(ids, x, k):
    x = x.astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = {}
    for n, i in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda m: (-round(s[n, m], 6), ids[m]))[:k]
        out[i] = [(ids[m], s[n, m]) for m in order]
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 64))
    x[1000:1300] = x[:300] * rng.uniform(0.5, 3, (300, 1)) + rng.normal(size=(300, 64)) * 0.1
    return np.arange(1, 1501), x


def test_near_pairs(spark, cloud):
    ids, x = cloud
    expected = {(int(min(i, j)), int(max(i, j))) for i, found in brute(ids, x, 5).items() for j, s in found if s >= 0.9}
    got = {tuple(r) for r in N.similar_pairs(table(spark, zip(ids.tolist(), x, strict=True))).collect()}
    assert len(expected) >= 300 and got <= expected and len(got) >= 0.99 * len(expected)


def test_recall_of_all_neighbours(spark, cloud):
    ids, x = cloud
    rows = N.nearest(table(spark, zip(ids.tolist(), x, strict=True)), recall=0.95, asked=F.col("chunk_id") % 20 == 0).collect()
    expected = {i: v for i, v in brute(ids, x, 5).items() if i % 20 == 0}
    got: dict = {}
    for r in rows:
        got.setdefault(r.chunk_id, {})[r.neighbour_id] = r.similarity
    assert set(got) == set(expected) and all(len(v) == 5 for v in got.values())
    hit = [n in got[i] for i, v in expected.items() for n, _ in v]
    assert np.mean(hit) >= 0.9
    true = {(i, n): s for i, v in brute(ids, x, 1500).items() for n, s in v}
    assert all(abs(true[(i, n)] - s) < 1e-5 for i, v in got.items() for n, s in v.items())


def test_exact(spark, cloud):
    ids, x = cloud
    got: dict = {}
    for r in N.nearest(table(spark, zip(ids.tolist(), x, strict=True)), exact=True).collect():
        got.setdefault(r.chunk_id, set()).add(r.neighbour_id)
    assert all({n for n, _ in v} == got[i] for i, v in brute(ids, x, 5).items())


def test_a_dense_region_is_split(spark, monkeypatch):
    monkeypatch.setattr(N, "PART_ENTRIES", 100)
    seen = []
    fit = N.fit_codebooks
    monkeypatch.setattr(N, "fit_codebooks", lambda *a: seen.append(fit(*a)) or seen[-1])
    rng = np.random.default_rng(5)
    x = np.concatenate([np.eye(64)[3] + rng.normal(size=(900, 64)) * 1e-3, rng.normal(size=(300, 64))])
    ids = np.arange(1200)
    rows = N.nearest(table(spark, zip(ids.tolist(), x, strict=True)), exact=True).collect()
    assert seen[0].splits.max() >= 3 and len(rows) == 6000
    share = seen[0].home(np.zeros(3000, int), np.arange(3000))
    assert len(np.unique(share)) == seen[0].splits[seen[0].group[0]]
    true = brute(ids[900:], x[900:], 299)
    got = {(r.chunk_id, r.neighbour_id): r.similarity for r in rows}
    assert all(abs(s - got[(i, n)]) < 1e-5 for i, v in true.items() for n, s in v if (i, n) in got)
    partial = N.nearest(table(spark, zip(ids.tolist(), x, strict=True)), recall=0.95, asked=F.col("chunk_id") % 20 == 0).collect()
    assert len(partial) == 300


def test_unusable_and_repeated_rows(spark):
    e = np.eye(64)
    bad = [(10, None), (11, []), (12, [1.0] * 63), (13, np.zeros(64)), (14, np.full(64, np.nan)), (15, [None, *[1.0] * 63]), (16, [float("inf"), *[1.0] * 63]), (None, e[0])]
    rows = [(1, e[0]), (1, e[0]), (2, e[0] * 7), (3, e[0] + 0.1 * e[1]), (4, e[5]), *bad]
    got = {(r.chunk_id, r.neighbour_id): round(r.similarity, 4) for r in N.nearest(table(spark, rows), exact=True).collect()}
    assert got[(1, 2)] == 1.0 and {i for i, _ in got} == {1, 2, 3, 4} and len(got) == 12
    assert {tuple(r) for r in N.similar_pairs(table(spark, rows)).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert N.nearest(table(spark, [])).count() == 0 and N.nearest(table(spark, bad)).count() == 0


def test_many_equal_vectors(spark):
    e = np.eye(64)
    rows = [(i, e[0]) for i in range(400)] + [(1000, e[0] + 0.01 * e[1]), (1001, e[2])]
    found = N.nearest(table(spark, rows), least=0.5, exact=True).collect()
    by: dict = {}
    for r in found:
        by.setdefault(r.chunk_id, []).append(r.neighbour_id)
    assert sorted(by[399]) == [0, 1, 2, 3, 4] and sorted(by[2]) == [0, 1, 3, 4, 5] and sorted(by[1000]) == [0, 1, 2, 3, 4]
    assert 1001 not in by and len(found) == 401 * 5


def test_traversal_is_the_heaps_order():
    import heapq

    rng = np.random.default_rng(2)
    d1, d2 = rng.random((20, 12)).astype(np.float32), rng.random((20, 12)).astype(np.float32)
    c1, c2, sums = N.traversal(d1, d2, 9)
    for q in range(20):
        a, b = np.argsort(d1[q]), np.argsort(d2[q])
        heap, seen, out = [(d1[q, a[0]] + d2[q, b[0]], 0, 0)], {(0, 0)}, []
        while len(out) < 9:
            s, i, j = heapq.heappop(heap)
            out.append((a[i], b[j]))
            for n in ((i + 1, j), (i, j + 1)):
                if max(n) < 12 and n not in seen:
                    seen.add(n)
                    heapq.heappush(heap, (d1[q, a[n[0]]] + d2[q, b[n[1]]], *n))
        assert list(zip(c1[q], c2[q], strict=True)) == out
    wide = N.traversal(d1, d2, 100)
    assert {*map(float, np.sort(wide[2][0])[:9])} == {*map(float, sums[0])}
