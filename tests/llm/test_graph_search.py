"""Graphs over tables of near copies and of few clusters, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import graph_search


def _third(r):
    x = r.standard_normal((2048, 64))
    x[:682] = r.standard_normal(64) + 0.2 * r.standard_normal((682, 64))
    return x


def _clusters(r):
    return r.standard_normal((8, 64))[r.integers(0, 8, 2048)] + 0.05 * r.standard_normal((2048, 64))


@pytest.mark.parametrize("table", [_third, _clusters])
def test_no_region_is_lost(table):
    x = table(np.random.default_rng(1)).astype(np.float32)
    ids = np.arange(len(x))
    found = [set() for _ in ids]
    for q, v, _ in graph_search.visit(graph_search.pack(ids, x, 11, degree=32, width=48), ids, x, 10, 96):
        found[q].add(v)
    apart = _apart(x.astype(np.float64))
    np.fill_diagonal(apart, np.inf)
    hit = [len(found[i] & set(np.argsort(apart[i])[:10].tolist())) for i in ids]
    assert min(hit) > 0 and np.mean(hit) / 10 >= 0.97


def _apart(x):
    sq = (x * x).sum(1)
    return sq[:, None] + sq - 2 * x @ x.T


def test_all_nodes_are_reached():
    x = _third(np.random.default_rng(1)).astype(np.float32)
    graph, entries = graph_search.build(x, width=48)
    seen = np.zeros(len(x), bool)
    seen[np.atleast_1d(entries)] = True
    while True:
        nxt = graph[seen]
        new = np.setdiff1d(nxt[nxt >= 0], np.flatnonzero(seen))
        if not len(new):
            break
        seen[new] = True
    assert seen.all()


def test_several_shards_against_brute_force(spark):
    """Repeated vectors, ties, another length, vectors that take no part, clashing columns; four shards."""
    r = np.random.default_rng(4)
    x = r.standard_normal((3000, 24))
    x[:900] = x[0] + 0.1 * r.standard_normal((900, 24))
    x[1500:1520] = x[1500]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("inf")] * 24), (5003, [1.0, 2.0]), (5004, [1.0, 3.0]), (0, x[0].tolist()), (None, x[1].tolist())]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"shard": F.lit("a"), "rank": F.lit(1), "dims": F.lit(None)})
    got = {}
    for q in graph_search.search(t, t.filter("vec_id % 20 = 0 or vec_id > 5000"), shard_rows=800, block_rows=50).collect():
        got.setdefault(q.query_id, []).append((q.rank, q.vec_id, q.score))
    hit = 0
    for q in range(0, 3000, 20):
        want = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in range(3000) if i != q)[:10]
        assert [n for n, _, _ in sorted(got[q])] == list(range(1, 11))
        hit += len({i for _, i in want} & {i for _, i, _ in got[q]})
    assert hit / 1500 >= 0.97
    assert [i for _, i, _ in sorted(got[1500])] == list(range(1501, 1511)) and all(s == 0 for _, _, s in got[1500])
    assert got[5003] == [(1, 5004, 1.0)] and not {5001, 5002} & set(got)
    assert graph_search.search(t.limit(0), t).count() == 0 == graph_search.search(t, t.limit(0)).count()


@pytest.mark.parametrize("size", [1e25, 1e-30])
def test_vectors_beyond_single_precision(spark, size):
    x = np.random.default_rng(5).standard_normal((200, 8)) * size
    x[100:] *= 1e-12
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in graph_search.search(t, t.filter("vec_id % 25 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, 100, 25):
        want = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in range(200) if i != q)[:10]
        assert got[q] == {i for _, i in want}
    assert all(len(g) == 10 for g in got.values())


def test_a_search_takes_fewer_distances_than_a_scan():
    x = np.random.default_rng(6).standard_normal((8192, 16)).astype(np.float32)
    took, ids = [], np.arange(len(x))
    index = graph_search.pack(ids, x, 11, degree=32, width=64)
    found = graph_search.visit(index, ids[:200], x[:200], 10, 128, took)
    apart = ((x[:200, None, :] - x[None]) ** 2).sum(2)
    apart[np.arange(200), np.arange(200)] = np.inf
    hit = sum(v in set(np.argsort(apart[q])[:10].tolist()) for q, v, _ in found)
    assert hit / 2000 >= 0.97 and sum(took) / 200 < len(x) / 3
