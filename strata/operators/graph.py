"""Reachability, impact, cycles and upserts on node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.lineage import checkpointed


def reach(starts: DataFrame, edges: DataFrame, hops: int, forward: bool = False, kinds: list[str] | None = None, type_only: bool = False) -> DataFrame:
    """``starts(start, node_id)`` -> ``(start, node_id, hop)``: nodes within ``hops`` edges, each with its least hop, starts left out.

    Edges are filtered and dealt by the end that hops start from once, and kept so for all hops: a hop shuffles its frontier
    alone. Pairs already reached are dropped before the next hop, and an empty frontier ends the search. Frontiers are
    checkpointed to the session's checkpoint folder, so that plans stay short and lost executors cost one hop.
    """
    e = edges.filter(F.lit(True) if type_only else ~F.col("is_type_only"))
    e = e.filter(F.col("kind").isin(kinds)) if kinds else e
    e = e.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("near")) if forward else e.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("near"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = checkpointed(e.distinct().repartition(parts, "node_id"))
    front = checkpointed(starts.select("start", "node_id", F.lit(0).alias("hop")).distinct())
    seen = front
    for hop in range(1, hops + 1):
        new = front.join(e, "node_id").select("start", F.col("near").alias("node_id")).distinct()
        front = checkpointed(new.join(seen, ["start", "node_id"], "left_anti").withColumn("hop", F.lit(hop)).select("start", "node_id", "hop"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("hop > 0")


def impact(nodes: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int = 3, cap: int | None = None) -> DataFrame:
    """``changed(file_path)`` -> ``(file_path, node_id, hop)``: what depends on a changed file's nodes; with ``cap`` the first by (hop, id).

    A file's own node counts only if another of its nodes reaches it.
    """
    own = changed.join(nodes, "file_path").select("file_path", F.col("node_id").alias("start"), "node_id")
    got = reach(own, edges, max_depth + 1).join(own.select("file_path", "start"), "start")
    got = got.groupBy("file_path", "node_id").agg(F.min("hop").alias("hop"))
    if cap is None:
        return got
    by = Window.partitionBy("file_path").orderBy("hop", "node_id")
    return got.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= cap).drop("_n")


def tests_of(own: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``own(..., node_id, kind, name)`` -> its other columns and the ``test_id`` of each node's tests.

    Tests are what a ``tests`` edge leads from, and for a module the test modules named ``test_x``, ``x_test`` and ``x_spec``.
    Modules that share a name ask for its tests once.
    """
    rest = [c for c in own.columns if c not in ("node_id", "kind", "name")]
    told = own.join(edges.filter("kind = 'tests'").select(F.col("target_id").alias("node_id"), F.col("source_id").alias("test_id")), "node_id").select(*rest, "test_id")
    names = F.explode(F.array(F.concat(F.lit("test_"), "name"), F.concat("name", F.lit("_test")), F.concat("name", F.lit("_spec")))).alias("name")
    called = nodes.filter("kind = 'module' and is_test").select("name", F.col("node_id").alias("test_id"))
    named = own.filter("kind = 'module'").select(*rest, names).distinct().join(called, "name").select(*rest, "test_id")
    return told.unionByName(named).distinct()


def relevance(nodes: DataFrame, edges: DataFrame, files: DataFrame, depth: int = 2) -> DataFrame:
    """``files(file_path)`` -> ``(node_id, priority)``: own nodes, then what their modules reach, then their tests; the first wins."""
    inner = nodes.filter("not is_external")
    own = files.join(inner, "file_path")
    starts = own.filter("kind = 'module'").select(F.col("node_id").alias("start"), "node_id")
    got = reach(starts, edges, depth + 1, forward=True, type_only=True).groupBy("node_id").agg(F.min("hop").alias("hop"))
    tests = tests_of(own.select("node_id", "kind", "name"), nodes, edges).select(F.col("test_id").alias("node_id"), F.lit(3).alias("rank"))
    every = (
        own.select("node_id", F.lit(0).alias("rank"))
        .unionByName(got.select("node_id", F.when(F.col("hop") <= 2, 1).otherwise(2).alias("rank")))
        .unionByName(tests)
    )
    every = every.groupBy("node_id").agg(F.min("rank").alias("rank")).join(inner.select("node_id"), "node_id", "left_semi")
    return every.select("node_id", priority(F.col("rank")).alias("priority"))


def relevance_by_symbol(nodes: DataFrame, edges: DataFrame, symbol: str, depth: int = 2, most: int = 50) -> DataFrame:
    """Matches of the symbol, what they depend on and what depends on them."""
    match = nodes.filter((F.col("name") == symbol) | (F.col("qualified_name") == symbol) | F.col("qualified_name").ilike(f"%.{symbol}")).orderBy("qualified_name", "node_id").limit(most)
    starts = match.select(F.col("node_id").alias("start"), "node_id")
    ahead = reach(starts, edges, depth + 1, forward=True, type_only=True).select("node_id", F.lit(1).alias("rank"))
    behind = reach(starts, edges, 2).select("node_id", F.lit(2).alias("rank"))
    every = match.select("node_id", F.lit(0).alias("rank")).unionByName(ahead).unionByName(behind)
    inner = nodes.filter("not is_external").select("node_id")
    return every.groupBy("node_id").agg(F.min("rank").alias("rank")).join(inner, "node_id").select("node_id", priority(F.col("rank")).alias("priority"))


def priority(rank: Column) -> Column:
    return F.when(rank == 0, "critical").when(rank == 1, "high").when(rank == 2, "medium").otherwise("low")


def cycles(edges: DataFrame, longest: int = 10, most: int | None = None) -> DataFrame:
    """Simple cycles up to ``longest`` nodes, from their least node on, as text; with ``most`` the shortest ones.

    Nodes that nothing leads to, or that lead to nothing, are in no cycle and go first, twice. Paths of each length are
    checkpointed, so that a longer one doesn't make them anew.
    """
    e = edges.filter("source_id <> target_id").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct()
    for _ in range(2):
        e = e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
    e = checkpointed(e)
    paths = e.filter("b > a").select(F.col("a").alias("head"), F.col("b").alias("tail"), F.array("a", "b").alias("path"))
    done = None
    for size in range(2, longest + 1):
        closed = paths.join(e.select(F.col("a").alias("tail"), F.col("b").alias("head")), ["tail", "head"]).select(F.array_join("path", ">").alias("cycle"), F.lit(size).alias("size"))
        done = closed if done is None else done.unionByName(closed)
        if size < longest:
            step = e.select(F.col("a").alias("tail"), F.col("b").alias("next"))
            paths = paths.join(step, "tail").filter("next > head and not array_contains(path, next)").select("head", F.col("next").alias("tail"), F.array_append("path", F.col("next")).alias("path"))
            paths = checkpointed(paths)
            if paths.isEmpty():
                break
    return done.orderBy("size", "cycle").limit(most) if most else done


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of both with the last of each key: rows of ``new`` win, among equals the greatest ``version``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    by = Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc("version"))
    return both.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n", "_new")


def remove_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of ``files``, and edges without those that touch a removed node."""
    gone = nodes.join(files, "file_path", "left_semi").select("node_id")
    left = edges.join(gone.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti")
    return nodes.join(files, "file_path", "left_anti"), left


def admit(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is known, whatever the order that files came in."""
    return edges.join(nodes.select(F.col("node_id").alias("target_id")), "target_id", "left_semi")
