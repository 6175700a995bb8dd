"""Connected components of an edge table by randomised contraction.

Each round hooks every node to the neighbour (or itself) that is first under a random order of
the ids, then replaces both ends of every edge by their hooks. The order changes each round
(ids xor a constant), so paths shrink by a constant factor in expectation and the number of
rounds is logarithmic. All state stays in tables; the driver sees one row count a round.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, drop_cut


def components(edges: DataFrame, seed: int = 7) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node long, root long)`` for every node of an edge.

    Nodes of one component share a root, which is one of them (which one is unspecified).
    Loops, repeated and reversed edges are harmless; rows with a null end are ignored; an empty
    table gives an empty table.
    """
    rng = random.Random(seed)
    e = cut(_clean(edges.select("a", "b")), "edges")
    roots: DataFrame | None = None
    while not e.isEmpty():
        key = rng.getrandbits(63)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min(F.col("b").bitwiseXOR(F.lit(key)))
        hook = both.groupBy(F.col("a").alias("node")).agg(first.alias("near"))
        hook = hook.select("node", F.least("near", F.col("node").bitwiseXOR(F.lit(key))).bitwiseXOR(F.lit(key)).alias("root"))
        hook = cut(hook, "hooks")
        to_a = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        nxt = cut(_clean(e.join(to_a, "a").join(to_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
        if roots is None:
            roots = hook
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
            old, roots = roots, cut(roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
            drop_cut(old)
            drop_cut(hook)
        drop_cut(e)
        e = nxt
    if roots is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def _clean(edges: DataFrame) -> DataFrame:
    return (
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
