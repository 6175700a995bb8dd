"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations that give balanced binary codes are learned on a bounded sample. Codes are cut into
substrings, one hash table each; vectors that agree in a substring are candidates, those whose
codes are within a Hamming radius are reranked with the original vectors. Substrings are as long
as a bucket of random vectors holds about one, and there are as many tables as find a pair at
the threshold itself with the wanted probability; closer pairs are found more surely.

The mean is taken from the vectors first, so that codes tell vectors of a common direction apart. That
widens the angle of a pair, so tables and radius are planned from the angles of pairs of the sample at the
threshold, measured about the mean taken. How much of the mean is taken is what gives the least work.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, drop_cut
from strata.llm.components import components
from strata.llm.forest import groups, merge, neighbours
from strata.llm.vectors import matrix, valid

#: most vectors that rotations are learned on (those with the smallest hash of their id)
SAMPLE = 4096
#: 64-bit words of code that are compared before reranking
WORDS = 3
#: most rows of a bucket that are compared in one piece; larger buckets are dealt into blocks, and pairs of blocks compared
BLOCK = 4096
#: buckets up to this size are compared many at once
SMALL = 24
LOG = logging.getLogger(__name__)

#: shares of the mean that are tried; without it the angle of a pair is that of its cosine, whatever the data
SHARES = (1.0, 0.75, 0.5, 0.25, 0.0)


def learn(x: np.ndarray, mean: np.ndarray, rotations: int, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """A (dims x dims * rotations) matrix: rotations that bring the sample less ``mean`` close to the corners of a cube."""
    v, d = x - mean, x.shape[1]
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(r)
    return np.concatenate(out, 1)


def flips(u: np.ndarray, v: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The share of bits in which the codes of each pair of rows differ."""
    a, b = u - mean, v - mean
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    cosine = np.einsum("ij,ij->i", a, b) / np.where(size > 0, size, 1)
    return np.arccos(np.clip(cosine, -1, 1)) / math.pi


def pairs_at(x: np.ndarray, least: float, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at cosine ``least``: each unit vector and one turned from it towards another; and the sample's own just above, if any."""
    w = x[np.random.default_rng(seed).permutation(len(x))]
    w = w - np.einsum("ij,ij->i", w, x)[:, None] * x
    size = np.linalg.norm(w, axis=1)
    far = size > 1e-6
    out = [(x[far], least * x[far] + math.sqrt(1 - least * least) * w[far] / size[far, None])]
    found = []
    for lo in range(0, len(x), 512):
        cosine = x[lo : lo + 512] @ x.T
        i, j = np.nonzero((cosine >= least) & (cosine <= least + (1 - least) / 5))
        some = np.unique(np.linspace(0, len(i) - 1, SAMPLE // 8).astype(int)) if len(i) else slice(0, 0)
        found.append(np.stack([i[some] + lo, j[some]]))
    i, j = np.concatenate(found, 1)
    return [(u, v) for u, v in [*out, (x[i], x[j])] if len(u)]


def plan(n: int, x: np.ndarray, least: float, recall: float) -> tuple[np.ndarray, int, int, int]:
    """For ``n`` vectors with the sample ``x`` of unit vectors: the mean to take, bits of a substring, number of tables, and radius."""
    total = WORDS * 64
    bits = min(30, max(8, math.ceil(math.log2(max(n, 2)))))
    pairs, other = pairs_at(x, least), x[np.random.default_rng(1).permutation(len(x))]
    plans = []
    for share in SHARES:
        mean = share * x.mean(0)
        each = [flips(u, v, mean) for u, v in pairs] or [np.array([math.acos(least) / math.pi])]
        tables = 1
        for f in each:
            missed = 1 - (1 - f) ** bits
            lo, hi = 0, 1
            while np.mean(missed**hi) > 1 - recall and hi < 1 << 40:
                lo, hi = hi, 2 * hi
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if np.mean(missed**mid) > 1 - recall else (lo, mid)
            tables = max(tables, hi)
        flip = max(float(np.quantile(f, 0.999)) for f in each)
        radius = math.ceil(flip * total + 5 * math.sqrt(flip * (1 - flip) * total))
        met = n * float(np.mean((1 - flips(x, other, mean)) ** bits)) / 2  # candidates of a vector in a table
        plans.append((tables * (1 + met), len(plans), mean, bits, tables, radius))
    return min(plans, key=lambda p: p[:2])[2:]


def recalled(x: np.ndarray, least: float, mean: np.ndarray, turn: np.ndarray, bits: int, tables: int, radius: int) -> float:
    """The share of the sample's pairs at the threshold that codes of this rotation bring together."""
    found = []
    for u, v in pairs_at(x, least):
        a, b = ((w - mean) @ turn >= 0 for w in (u, v))
        differ = a != b
        meet = (~differ[:, : tables * bits].reshape(len(u), tables, bits).any(2)).any(1)
        found.append(np.mean(meet & (differ[:, : WORDS * 64].sum(1) <= radius)))
    return min(found, default=1.0)


def fitted(n: int, x: np.ndarray, least: float, recall: float) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """Mean, rotations, bits, tables and radius; tables are added until the sample's pairs at the threshold are found."""
    mean, bits, tables, radius = plan(n, x, least, recall)
    for left in range(4, -1, -1):
        turn = learn(x, mean, math.ceil(max(tables * bits, WORDS * 64) / x.shape[1]))
        got = recalled(x, least, mean, turn, bits, tables, radius)
        if got >= recall - 0.02 or not left:
            break
        tables, radius = math.ceil(1.5 * tables), min(WORDS * 64, radius + 4)
    LOG.log(logging.INFO if got >= 0.9 else logging.WARNING, "pairs of the sample at cosine %s found: %.3f (%d tables of %d bits, radius %d)", least, got, tables, bits, radius)
    return mean, turn, bits, tables, radius


def _agree(c: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Whether codes meet in a table before their own, as far as the code's words hold its bits."""
    differ = np.unpackbits((c[i] ^ c[j]).view(np.uint8), axis=1)
    whole = WORDS * 64 // bits
    met = ~differ[:, : whole * bits].reshape(len(i), whole, bits).any(2)
    return (met & (np.arange(whole) < table[:, None])).any(1)


def _survivors(bits: int, radius: int):
    """Rows (t, k, rep, words) sorted by bucket -> (t, k, blk, rep) of those with a partner within the radius.

    Buckets of ``BLOCK`` rows and more aren't searched here: all their rows go on, dealt into blocks as they stream by.
    """

    def test(rows: np.ndarray) -> np.ndarray:
        starts, sizes = groups(rows[:, :2])
        keep = np.zeros(len(rows), bool)
        c = np.ascontiguousarray(rows[:, 3:]).view(np.uint64)  # signed numbers would be counted by their absolute values

        def mark(i: np.ndarray, j: np.ndarray) -> None:
            near = np.bitwise_count(c[i] ^ c[j]).sum(1) <= radius
            i, j = i[near], j[near]
            new = ~_agree(c, i, j, rows[i, 0], bits)
            keep[i[new]] = keep[j[new]] = True

        for i, j in neighbours(starts, sizes, SMALL):
            mark(i, j)
        for lo, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            for a in range(lo, lo + n):  # a row at a time: at most BLOCK of them
                mark(np.full(lo + n - a - 1, a), np.arange(a + 1, lo + n))
        return keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, hot, blk = np.empty((0, 3 + WORDS), np.int64), None, 0

        def out(rows: np.ndarray, blocks: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1].copy()), pa.array(blocks.astype(np.int32)), pa.array(rows[:, 2].copy())], ["t", "k", "blk", "rep"])

        def done(rows: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest, hot, blk
            starts, sizes = groups(rows[:, :2])
            plain = np.ones(len(rows), bool)
            rest = rows[:0]
            for g in np.flatnonzero((sizes >= BLOCK) | (starts == 0) | (starts + sizes == len(rows))):
                lo, n = int(starts[g]), int(sizes[g])
                own, key, open_ = rows[lo : lo + n], tuple(rows[lo, :2]), lo + n == len(rows) and not last
                if key != hot and n < BLOCK:
                    if open_:
                        rest, plain[lo:] = own, False
                    continue
                if key != hot:
                    hot, blk = key, 0
                plain[lo : lo + n] = False
                whole = n // BLOCK * BLOCK if open_ else n
                if whole:
                    yield out(own[:whole], blk + np.arange(whole) // BLOCK)
                    blk += math.ceil(whole / BLOCK)
                if open_:
                    rest = own[whole:]
            cold = rows[plain]
            if len(cold) and (keep := test(cold)).any():
                yield out(cold[keep], np.zeros(keep.sum()))

        for b in batches:
            yield from done(np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1).astype(np.int64)]), False)
        yield from done(rest, True)

    return run


def _verify(least: float):
    """Rows (t, k, lo, hi, blk, rep, copies, keys, embedding) sorted by block pair -> (a, b, n).

    ``b``: a link of a spanning forest; ``n``: copies of the vectors linked to ``a``. A pair counts in the first table that it meets in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            starts, _ = groups(_head(t))
            if len(starts) > 1:
                yield _links(t.slice(0, starts[-1]), least)
            rest = t.slice(starts[-1]) if len(starts) else t
        if rest is not None and rest.num_rows:
            yield _links(rest, least)

    return run


def _head(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(i).to_numpy().astype(np.int64) for i in range(4)], 1) if t.num_rows else np.empty((0, 4), np.int64)


def _links(t: pa.Table, least: float) -> pa.RecordBatch:
    head, blk, rep, copies = _head(t), *(t.column(i).to_numpy() for i in (4, 5, 6))
    keys, raw = matrix(t.column(7)), matrix(t.column(8)).astype(np.float64)
    size = np.linalg.norm(raw, axis=1)
    unit = raw / size[:, None]
    starts, sizes = groups(head)
    top, near = np.arange(len(rep)), np.zeros(len(rep), np.int64)

    def count(i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> None:
        nonlocal top, near
        edge = np.abs(cosine - least) < 1e-9  # so close that the order of operations could decide: as the measure is defined
        if edge.any():
            x, y = i[edge], j[edge]
            cosine[edge] = np.einsum("ij,ij->i", raw[x], raw[y]) / (size[x] * size[y])
        ok = cosine >= least
        i, j = i[ok], j[ok]
        table = head[i, 0]
        for s in range(int(table.max(initial=0))):  # near copies mostly meet early on, so few pairs are left soon
            first = (keys[i, s] != keys[j, s]) | (s >= table)
            if not first.all():
                i, j, table = i[first], j[first], table[first]
        near += (np.bincount(i, copies[j], len(near)) + np.bincount(j, copies[i], len(near))).astype(np.int64)
        top = merge(top, i, j)

    for i, j in neighbours(starts, sizes, SMALL):
        same = (head[i, 2] == head[i, 3]) | (blk[i] != blk[j])
        i, j = i[same], j[same]
        count(i, j, np.einsum("ij,ij->i", unit[i], unit[j]))
    for lo, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        within, left = head[lo, 2] == head[lo, 3], np.arange(lo, lo + n)
        other = left if within else left[blk[left] == head[lo, 3]]
        left = left if within else left[blk[left] == head[lo, 2]]
        for at in range(0, len(left), 256):
            own = left[at : at + 256]
            cosine = unit[own] @ unit[other].T
            i, j = np.nonzero(cosine >= least - 1e-9)
            i, j, c = own[i], other[j], cosine[i, j]
            if within:
                up = i < j
                i, j, c = i[up], j[up], c[up]
            count(i, j, c)
    linked, met = np.flatnonzero(top != np.arange(len(top))), np.flatnonzero(near)
    a = np.concatenate([rep[linked], rep[met]])
    b = pa.concat_arrays([pa.array(rep[top[linked]], pa.int64()), pa.nulls(len(met), pa.int64())])
    n = pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(near[met], pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, n], ["a", "b", "n"])


def links(reps: DataFrame, dims: int, least: float, recall: float) -> DataFrame:
    """``reps(rep, copies, embedding)`` of one length -> ``(a, b, n)``, see :func:`_verify`; no pair of a bucket is ever a row."""
    spark, n = reps.sparkSession, reps.count()
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow()
    x = matrix(sample.column(0)).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, turn, bits, tables, radius = fitted(n, x, least, recall)
    sent = spark.sparkContext.broadcast((mean, turn))  # dims x (bits of the code), whatever the table's size

    def keyed(v: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = ((v / np.linalg.norm(v, axis=1, keepdims=True) - mean) @ turn) >= 0
        power = (1 << np.arange(bits, dtype=np.int32))[:, None]
        return np.packbits(code[:, : WORDS * 64], axis=1).view(np.int64), (code[:, : tables * bits].reshape(len(v), tables, bits).astype(np.int32) @ power)[:, :, 0]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                words, keys = keyed(matrix(b.column(2)).astype(np.float64), *sent.value)
                lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * tables, keys.ravel())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(words[:, w].copy()) for w in range(WORDS)], lists, b.column(2)], ["rep", "copies", *words_, "keys", "embedding"])

    words_ = [f"c{w}" for w in range(WORDS)]
    kind = reps.schema["embedding"].dataType.simpleString()
    coded = reps.select("rep", "copies", "embedding").mapInArrow(encode, f"rep long, copies long, {', '.join(f'{w} long' for w in words_)}, keys array<int>, embedding {kind}")
    coded = cut(coded, "codes")
    entries = coded.select(F.posexplode("keys").alias("t", "k"), "rep", *words_).withColumn("k", F.col("k").cast("long"))
    # buckets that hold much of the sample would be one long task: they are dealt into blocks at once. At most 64 a table
    own = keyed(x, mean, turn)[1]
    giant = []
    for t in range(tables):
        key, count = np.unique(own[:, t], return_counts=True)
        giant += [(t, int(k), math.ceil(1.5 * c / len(own) * n / BLOCK)) for k, c in zip(key, count) if 64 * c >= len(own) and c / len(own) * n > BLOCK]
    select = _survivors(bits, radius)
    if giant:
        entries = entries.join(F.broadcast(spark.createDataFrame(giant, "t int, k long, nb int")), ["t", "k"], "left")
        dealt = entries.filter("nb is not null").select("t", "k", F.pmod(F.xxhash64("rep"), F.col("nb").cast("long")).cast("int").alias("blk"), "rep")
        entries = entries.filter("nb is null")
    cold = entries.select("t", "k", "rep", *words_).repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(select, "t int, k long, blk int, rep long")
    found = cut(cold.unionByName(dealt) if giant else cold, "met")
    blocks = found.groupBy("t", "k").agg((F.max("blk") + 1).alias("nb")).filter("nb > 1")  # one row a bucket of many rows
    rows = found.join(blocks, ["t", "k"], "left").join(coded.select("rep", "copies", "keys", "embedding"), "rep")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("nb", F.lit(1)) - 1)))
    rows = rows.select("t", "k", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "rep", "copies", "keys", "embedding")
    out = cut(rows.repartition("t", "k", "lo", "hi").sortWithinPartitions("t", "k", "lo", "hi").mapInArrow(_verify(least), "a long, b long, n long"), "links")
    drop_cut(coded)
    drop_cut(found)
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.9, recall: float = 0.99) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(vec_id, n_links, component_id, kept)``, a row a row.

    Equal vectors are one in the search and count as linked copies. Vectors that are null, zero or
    not finite, and rows without an id, link with nothing: their component is their own id. Vectors
    link only with those of their own length. An empty table gives an empty table.
    """
    same = [F.xxhash64("embedding").alias("h1"), F.xxhash64("embedding", F.lit(1)).alias("h2")]
    rows = valid(vectors).select("*", *same)
    reps = cut(rows.groupBy("h1", "h2", "dims").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")), "reps")
    found = None
    for dims in sorted(r["dims"] for r in reps.select("dims").distinct().collect()):  # one row a vector length
        one = links(reps.filter(F.col("dims") == dims), dims, least, recall)
        found = one if found is None else found.unionByName(one)
    every = vectors.select(F.col("vec_id").cast("long"), *same)
    if found is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    near = found.filter("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("near"))
    roots = components(found.filter("b is not null")).withColumnRenamed("node", "rep")
    at = reps.join(near, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    ids = at.groupBy("root").agg(F.min("rep").alias("component_id"))
    at = at.join(ids, "root").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), "component_id")
    sound = F.col("vec_id").isNotNull() & F.col("h1").isNotNull()
    out = every.join(at, ["h1", "h2"], "left").select("vec_id", F.when(sound, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(sound, F.coalesce("component_id", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
