"""Nearest neighbours on robust-pruned directed graphs.

Vectors are dealt into shards of bounded size, large enough that a search takes the distance to a part of a shard only. A shard's graph is built by inserting its vectors
in growing batches: a greedy beam search over the graph so far proposes neighbours, and relaxed
distance pruning keeps a neighbour only if no kept one is closer to it by the factor ``alpha``.
Among many near copies no candidate is pruned, so a node's places all go to its own group. A graph
therefore has many entries: vectors far from each other, one for each group that could use up
its nodes' places; then one for each part not reached from them, and every vector that a search for
itself does not find. Searches start at the entries nearest the query. Graphs are written to the shared folder; blocks of queries then visit every shard, and a beam
search in each proposes vectors whose distances are taken again in double precision.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut
from strata.llm.vectors import matrix, valid

SCHEMA = "query_id long, rank int, vec_id long, score double"


def _sq(x: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x[at] - q[:, None, :]
    return np.einsum("abd,abd->ab", d, d)


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int, took: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``width`` nearest places found (-1: none) and their squared distances, nearest first.

    No distance is taken twice; ``took`` gets how many were taken in all.
    """
    n, first = len(q), min(width, len(entries))
    ids = np.full((n, width), -1, np.int32)
    dist = np.full((n, width), np.inf, x.dtype)
    done = np.ones((n, width), bool)
    seen = np.zeros((n, len(x)), bool)
    e = x[entries]
    far = (e * e).sum(1) - 2 * (q @ e.T)  # less each query's own square
    ids[:, :first] = entries[np.argsort(far, 1, kind="stable")[:, :first]]
    dist[:, :first], done[:, :first] = _sq(x, ids[:, :first], q), False
    seen[:, entries] = True
    taken = far.size
    order = np.argsort(dist, 1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    live = np.arange(n)
    while len(live):
        open_ = ~done[live]
        live, pick = live[open_.any(1)], open_.argmax(1)[open_.any(1)]  # rows are sorted: the first open one is nearest
        if not len(live):
            break
        done[live, pick] = True
        nb = graph[ids[live, pick]]
        r, c = np.nonzero((nb >= 0) & ~seen[live[:, None], nb])
        new = nb[r, c]
        seen[live[r], new] = True
        taken += len(new)
        d, i, o = np.full(nb.shape, np.inf, x.dtype), np.full(nb.shape, -1, np.int32), np.ones(nb.shape, bool)
        apart = x[new] - q[live[r]]
        d[r, c], i[r, c], o[r, c] = np.einsum("ij,ij->i", apart, apart), new, False
        both_d = np.concatenate([dist[live], d], 1)
        order = np.argsort(both_d, 1, kind="stable")[:, :width]
        dist[live] = np.take_along_axis(both_d, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], i], 1), order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], o], 1), order, 1)
    if took is not None:
        took.append(taken)
    return ids, dist


def robust_prune(x: np.ndarray, cand: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each row up to ``degree`` of the candidates (-1: none): the nearest, then those no kept one outbids."""
    order = np.argsort(dist, 1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    alive = (cand >= 0) & np.isfinite(dist)
    v = x[np.maximum(cand, 0)]
    sq = np.einsum("abd,abd->ab", v, v)
    between = np.maximum(sq[:, :, None] + sq[:, None, :] - 2 * (v @ v.transpose(0, 2, 1)), 0)
    out = np.full((len(cand), degree), -1, np.int32)
    row = np.arange(len(cand))
    for k in range(degree):
        any_ = alive.any(1)
        if not any_.any():
            break
        p = alive.argmax(1)
        out[:, k] = np.where(any_, cand[row, p], -1)
        outbid = alpha * alpha * between[row, p] <= dist
        alive &= ~outbid
        alive[row, p] = False
    return out


def spread(x: np.ndarray, count: int) -> np.ndarray:
    """The place nearest the mean, then up to ``count - 1`` times the one farthest from those taken."""
    at = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
    near = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < count and near.max() > 0:  # vectors that are the same in single precision are taken once
        at.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    return np.array(at, np.int32)


def reached(graph: np.ndarray, entries: np.ndarray, seen: np.ndarray) -> None:
    """Marks in ``seen`` what the entries lead to."""
    edge = np.asarray(entries, np.int32)
    while len(edge):
        seen[edge] = True
        edge = np.unique(graph[edge])
        edge = edge[(edge >= 0) & ~seen[edge]]


def join_in(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, width: int, batch: int) -> np.ndarray:
    """The entries and more: with them all nodes are reached, and found by a search of ``width``."""
    seen = np.zeros(len(x), bool)
    reached(graph, entries, seen)
    more = []
    while not seen.all():
        more.append(int(seen.argmin()))
        reached(graph, np.array(more[-1:]), seen)
    entries = np.concatenate([entries, np.array(more, np.int32)])
    lost = []
    for lo in range(0, len(x), batch):
        own = np.arange(lo, min(lo + batch, len(x)), dtype=np.int32)
        lost.append(own[(beam_search(x, graph, entries, x[own], width)[0] != own[:, None]).all(1)])
    return np.unique(np.concatenate([entries, *lost]))


def build(x: np.ndarray, degree: int = 32, width: int = 64, alpha: float = 1.2, batch: int = 256, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Out-neighbours (n x degree, -1: none) and the entries of a graph over distinct vectors."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    # no more groups than n / degree have more vectors than a node has places; of more than 256, join_in finds those that are cut off
    entries = spread(x, min(math.ceil(n / degree), 256))
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    order = np.concatenate([entries, order[~np.isin(order, entries)]]).astype(np.int32)
    lo = 1
    while lo < n:
        new = order[lo : lo + min(batch, lo)]
        ids, dist = beam_search(x, graph, entries[:lo], x[new], width)
        graph[new] = robust_prune(x, ids, dist, degree, alpha)
        # edges back: a full neighbour is pruned again over its own and the new edges
        src = np.repeat(new, degree)
        dst = graph[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        at, start, count = np.unique(dst, return_index=True, return_counts=True)
        has = (graph[at] >= 0).sum(1)
        room = has + count <= degree
        for v, s, c, h in zip(at[room], start[room], count[room], has[room]):
            graph[v, h : h + c] = src[s : s + c]
        if not room.all():
            v, s, c = at[~room], start[~room], count[~room]
            cand = np.full((len(v), degree + int(c.max())), -1, np.int32)
            cand[:, :degree] = graph[v]
            for r, (i, k) in enumerate(zip(s, c)):
                cand[r, degree : degree + k] = src[i : i + k]
            d = np.where(cand >= 0, _sq(x, cand, x[v]), np.inf)
            graph[v] = robust_prune(x, cand, d, degree, alpha)
        lo += len(new)
    return graph, join_in(x, graph, entries, width, batch)


def narrow(x: np.ndarray) -> tuple[np.ndarray, float]:
    """``x`` over its largest component, in single precision unless the vectors' lengths are too unlike for it; and that component."""
    scale = float(np.abs(x).max())
    y = np.ascontiguousarray(x / scale)
    size = np.sqrt((y * y).sum(1))
    return (y.astype(np.float32) if size.min() > 1e-2 * size.max() else y), scale


def pack(ids: np.ndarray, x: np.ndarray, copies: int, **how) -> bytes:
    """A shard's index; of equal vectors one is in the graph, with their ``copies`` smallest ids."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    _, first, inverse = np.unique(x, axis=0, return_index=True, return_inverse=True)
    by = np.argsort(inverse.ravel(), kind="stable")
    groups = [np.unique(g)[:copies] for g in np.split(ids[by], np.cumsum(np.bincount(inverse.ravel()))[:-1])]
    graph, entries = build(narrow(x[first].astype(np.float64))[0], **how)
    return pickle.dumps((x[first], groups, graph, entries))


def visit(index: bytes, query_ids: np.ndarray, q: np.ndarray, k: int, width: int, took: list[int] | None = None, piece: int = 256) -> list[tuple[int, int, float]]:
    """(query, vector, distance): each query's ``k`` nearest found in the shard, without its own id; ``piece`` queries at once."""
    x, groups, graph, entries = pickle.loads(index)
    x64 = x.astype(np.float64)
    near, scale = narrow(x64)
    out = []
    for lo in range(0, len(q), piece):
        own64 = q[lo : lo + piece].astype(np.float64)
        asked = own64 / scale
        at_ = near if np.abs(asked).max() < 1e3 else near.astype(np.float64)
        found, _ = beam_search(at_, graph, entries, asked.astype(at_.dtype), min(width, len(x)), took)
        for i, own in enumerate(query_ids[lo : lo + piece].tolist()):
            at = found[i][found[i] >= 0]
            # summed from the first component to the last, so that the measure doesn't depend on how it is vectorised
            dist = np.sqrt(np.add.accumulate((x64[at] - own64[i]) ** 2, axis=1)[:, -1])
            best = sorted((d, v) for a, d in zip(at.tolist(), dist.tolist()) for v in groups[a].tolist() if v != own)
            out += [(own, v, d) for d, v in best[:k]]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 16384, block_rows: int = 4096, degree: int = 32, width: int = 128) -> DataFrame:
    """The ``k`` nearest of ``vectors`` to each of ``queries`` (both vec_id, embedding) -> ``SCHEMA``.

    Ids are not compared with themselves, equal distances go by the smaller id, rows repeated in id
    and vector count once. Rows without an id, and vectors that are null, zero or not finite, take
    no part; vectors meet only those of their own length; other columns are ignored. No valid rows: no rows.
    A shard's index travels to as many tasks as there are blocks of ``block_rows`` queries, a query's vector
    to every shard. Graphs save distances only where a shard is much larger than ``width * degree``.
    """
    rows, asked = valid(vectors), valid(queries)
    shards = max(1, math.ceil(rows.count() / shard_rows))
    blocks = max(1, math.ceil(asked.count() / block_rows))

    def make(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        index = pack(t.column("vec_id").to_numpy(), matrix(t.column("embedding")), k + 1, degree=degree, width=max(width // 2, degree))
        return pa.table({"shard": [key[0].as_py()], "dims": [key[1].as_py()], "index": pa.array([index], pa.binary())}, schema=pa.schema([("shard", pa.int32()), ("dims", pa.int32()), ("index", pa.binary())]))

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    graphs = cut(dealt.groupBy("shard", "dims").applyInArrow(make, "shard int, dims int, index binary"), "graphs")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    # a block holds about block_rows queries; every shard gets each block
    packed = asked.dropDuplicates(["vec_id", "embedding"]).groupBy("dims", block.alias("block")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("asked"))
    visits = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(graphs, ["shard", "dims"]).select("index", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for index, q in zip(b.column(0), b.column(1)):
                ids, vec = q.values.field(0).to_numpy(), matrix(q.values.field(1))
                got = visit(index.as_py(), ids, vec, k, width)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    near = visits.mapInArrow(run, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
