"""SimHash near-duplicates with broadcast BK-trees.

A BK-tree keys every child by its integer Hamming distance to the parent, and a search follows only the
edges within the radius of the distance found at a node. Fingerprints are cut into four blocks of 16 bits;
two that differ in three bits or fewer agree in one of them, so a fingerprint stands in four shards, one a
block, keyed by as many of the block's bits as leave a shard some hundred fingerprints. Shards are put together
to parcels of a bounded number of fingerprints, each parcel's trees are built by one task and written to the
shared folder; then parcel after parcel is broadcast and searched by all fingerprints. What a search gives is
a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, drop_cut
from strata.llm.components import components
from strata.llm.forest import merge

RADIUS = 3
#: most fingerprints in the trees that are broadcast at once: about 100 MB
PARCEL = 4_000_000


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the 3-word shingles; 0 for a text without words."""
    import re

    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= 3 else (b" ".join(words),)
    n = max(1, len(words) - 2)
    count, digest, lo = np.zeros(64, np.int64), xxhash.xxh64_intdigest, 0
    while lo < n:  # in pieces, so that a very long text needs no more memory
        k = min(n - lo, 1 << 16)
        h = np.fromiter((digest(next(shingles) if len(words) >= 3 else shingles[0], 42) for _ in range(k)), np.uint64, k)
        count += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(k, 64).sum(0, dtype=np.int64)
        lo += k
    return int(np.packbits(count * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp long)``, a row a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array((fingerprint(t.as_py()) for t in b.column(1)), pa.int64(), size=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), made], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


@dataclass
class Trees:
    """BK-trees over distinct values, one for each run of equal ``shard``: node ``i`` has the children ``first[i]`` to ``first[i + 1]`` of ``child``, by distance."""

    shard: np.ndarray  # of each tree, ascending
    root: np.ndarray
    value: np.ndarray
    first: np.ndarray
    child: np.ndarray
    edge: np.ndarray


def grow(shard: np.ndarray, value: np.ndarray) -> Trees:
    """Trees of rows sorted by shard. All rows go down one level at a time; the first to reach a free edge becomes a node there."""
    n = len(value)
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.empty(0, np.int64)
    root = np.repeat(starts, np.diff(np.r_[starts, n]))
    parent, edge = np.full(n, -1), np.zeros(n, np.uint8)
    at = root.copy()
    left = np.setdiff1d(np.arange(n), starts, assume_unique=True)
    while len(left):
        d = np.bitwise_count(value[left] ^ value[at[left]])
        key = at[left] * 65 + d
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        own = left[one]
        parent[own], edge[own] = at[own], d[one]
        at[left] = own[which]
        left = np.delete(left, one)
    order = np.lexsort((edge, parent))
    order = order[parent[order] >= 0]
    first = np.zeros(n + 1, np.int64)
    np.add.at(first, parent[order] + 1, 1)
    return Trees(shard[starts], starts, value, np.cumsum(first), order, edge[order])


def search(trees: Trees, shard: np.ndarray, value: np.ndarray, radius: int = RADIUS, piece: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of the query, node) within the radius, for queries in the tree of their shard; shards without a tree find nothing."""
    if not len(trees.shard):
        return
    tree = np.minimum(np.searchsorted(trees.shard, shard), len(trees.shard) - 1)
    row = np.flatnonzero(trees.shard[tree] == shard)
    todo = [(row[lo : lo + piece], trees.root[tree[row[lo : lo + piece]]]) for lo in range(0, len(row), piece)]
    while todo:  # depth first, in pieces, so that memory is bounded however many nodes lie within reach
        row, node = todo.pop()
        d = np.bitwise_count(value[row] ^ trees.value[node]).astype(np.int64)
        if (hit := d <= radius).any():
            yield row[hit], node[hit]
        lo, hi = trees.first[node], trees.first[node + 1]
        some = hi > lo
        row, d, lo, size = row[some], d[some], lo[some], (hi - lo)[some]
        if not len(row):
            continue
        each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        go = np.abs(trees.edge[each].astype(np.int64) - np.repeat(d, size)) <= radius
        row, node = np.repeat(row, size)[go], trees.child[each[go]]
        todo += [(row[i : i + piece], node[i : i + piece]) for i in range(0, len(row), piece)]


def links(fps: DataFrame, parcel: int = PARCEL, least: int = PARCEL // 40, fill: int = 256) -> DataFrame:
    """Distinct ``fp`` -> ``(a, b)`` links whose components are those of all links within the radius.

    A parcel holds at most about ``parcel`` fingerprints of trees (24 bytes each), and an eighth of them all where that is
    less, but ``least``. A shard larger than a parcel's half is dealt over several trees, each searched.
    """
    spark, n = fps.sparkSession, fps.count()
    bits = min(16, max(0, math.ceil(math.log2(max(n, 1) / fill))) if n > fill else 0)
    size = min(parcel, max(least, n // 2))
    part = {t: F.shiftrightunsigned("fp", 16 * t + 16 - bits).bitwiseAND((1 << bits) - 1) for t in range(4)}
    keys = F.explode(F.array(*[F.lit(t << 16).bitwiseOR(k.cast("int")) for t, k in part.items()]))
    entries = fps.select(keys.alias("shard"), "fp")
    sizes = entries.groupBy("shard").agg(F.count("*").alias("n"))  # at most 4 * 65,536 rows
    split = cut(sizes.select("shard", F.ceil(F.col("n") / (size // 2)).cast("int").alias("parts")), "shards")
    parcels = max(1, math.ceil(4 * n / size))
    placed = entries.join(F.broadcast(split), "shard").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")))
    # shards of one tree fill parcels by their hash; the parts of larger ones go to parcels of their own
    home = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("shard"), F.lit(parcels)).cast("string")).otherwise(F.concat_ws(":", "shard", "part"))
    placed = placed.select(home.alias("home"), F.col("shard").cast("long"), "fp")

    def build(t: pa.Table) -> pa.Table:
        shard, value = t.column(1).to_numpy(), t.column(2).to_numpy().view(np.uint64)
        order = np.lexsort((value, shard))
        return pa.table({"home": t.column(0)[:1], "trees": pa.array([pickle.dumps(grow(shard[order], value[order]))], pa.binary())})

    grown = cut(placed.groupBy("home").applyInArrow(build, "home string, trees binary"), "trees")
    found = []
    for home in sorted(r.home for r in grown.select("home").collect()):
        sent = spark.sparkContext.broadcast(grown.filter(F.col("home") == home).select("trees").first()[0])  # of bounded size
        found.append(cut(fps.select("fp").mapInArrow(_seeker(sent, bits), "a long, b long"), "links"))
        sent.unpersist()
    drop_cut(grown)
    drop_cut(split)
    return reduce(DataFrame.unionByName, found) if found else fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))


def _seeker(sent, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = pickle.loads(sent.value)
        for b in batches:
            q = b.column(0).to_numpy().view(np.uint64)
            at = [np.uint64(t << 16) | ((q >> np.uint64(16 * t + 16 - bits)) & np.uint64((1 << bits) - 1)) for t in range(4)]
            shard, row = np.concatenate(at).astype(np.int64), np.tile(np.arange(len(q)), 4)
            # queries and nodes as one row of places: first the batch, then the trees
            top, held, seen = np.arange(len(q) + len(trees.value)), [], 0
            for i, node in search(trees, shard, q[row]):
                apart = q[row[i]] != trees.value[node]
                held.append((row[i[apart]], len(q) + node[apart]))
                seen += int(apart.sum())
                if seen > 1 << 21:
                    top, held, seen = merge(top, *map(np.concatenate, zip(*held))), [], 0
            if held:
                top = merge(top, *map(np.concatenate, zip(*held)))
            value = np.concatenate([q, trees.value]).view(np.int64)
            linked = np.flatnonzero(top != np.arange(len(top)))
            yield pa.RecordBatch.from_arrays([pa.array(value[top[linked]]), pa.array(value[linked])], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fingerprint, component_id)``, a row a row.

    Null and wordless texts have fingerprint zero and link like any other. Rows without an id get
    the component of their fingerprint; a component of such rows only has a null id. Repeated
    rows stay; an empty table gives an empty table; other columns are ignored, whatever their names.
    A text is taken whole, a piece of its shingles at a time, however long it is.
    """
    by_doc = cut(fingerprints(docs), "simhash")
    fps = cut(by_doc.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    roots = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    at = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = at.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = at.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return by_doc.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
