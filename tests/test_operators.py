"""Small graphs and packings with known answers."""

from strata.operators import budget, graph


def edges(spark, rows):
    return spark.createDataFrame([(a, b, k, t) for a, b, k, t in rows], "source_id long, target_id long, kind string, is_type_only boolean")


def starts(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "start long, node_id long")


def test_reach_chain_cycle_and_filters(spark):
    e = edges(spark, [(1, 2, "imports", False), (2, 3, "imports", False), (3, 1, "calls", True)])
    got = lambda **k: sorted((r.node_id, r.hop) for r in graph.reach(starts(spark, 3), e, **k).collect())
    assert got(hops=1) == [(2, 1)]
    assert got(hops=5) == [(1, 2), (2, 1)]
    assert got(hops=3, forward=True, type_only=True) == [(1, 1), (2, 2)]
    assert got(hops=3, kinds=["calls"]) == []


def test_greedy_fold_goes_on_after_an_item_that_does_not_fit(spark):
    items = spark.createDataFrame([(1, 1, 1.0, 50, 1), (1, 3, 1.0, 60, 2), (1, 3, 0.5, 20, 3)], "request int, rank int, freshness double, tokens long, ordinal long")
    assert sorted((r.ordinal, r.taken) for r in budget.pack(items, 80).collect()) == [(1, True), (2, False), (3, True)]
    assert not any(r.taken for r in budget.pack(items, 0).collect())


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3)], "k int, v string, version int")
    assert sorted((r.k, r.v) for r in graph.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "d")]


def test_usable_budget():
    assert budget.usable(8000) == 7200 and budget.usable(10, reserved=20) == 0


def test_places_of_a_distributed_sort(spark):
    from pyspark.sql import functions as F

    from strata.operators import ranking, usage

    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), (F.col("id") % 3).alias("y")).repartition(7)
    got = ranking.placed(rows, F.desc("y"), "x").collect()
    want = sorted(((r.x, r.y) for r in got), key=lambda r: (-r[1], r[0]))
    assert [(r.x, r.y) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(5000))
    assert ranking.placed(rows.limit(0), "x").count() == 0
    nodes = spark.createDataFrame([(f"f{i:02d}", False, False) for i in range(10) for _ in range(20 - i)] + [("t", True, False)], "file_path string, is_test boolean, is_generated boolean")
    assert sorted((r.place, r.file_path) for r in usage.scenario_files(nodes).collect()) == [(0, "f00"), (3, "f03"), (6, "f06"), (9, "f09")]
    assert usage.scenario_files(nodes.limit(0)).count() == 0


def test_cycles_and_an_early_end(spark):
    e = edges(spark, [(1, 2, "imports", False), (2, 3, "imports", False), (3, 1, "calls", False), (3, 4, "calls", False), (2, 1, "calls", False), (5, 1, "calls", False), (6, 6, "calls", False)])
    assert [(r.cycle, r.size) for r in graph.cycles(e, 10, most=50).collect()] == [("1>2", 2), ("1>2>3", 3)]
    assert graph.cycles(e, 10, most=1).count() == 1 and graph.cycles(e.limit(0)).count() == 0
    assert graph.reach(starts(spark, 4), e, 9, forward=True).count() == 0 and graph.reach(starts(spark), e, 3).count() == 0
