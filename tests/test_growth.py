"""Steps whose rows must grow with the input and not with its square, and queries on keys that the small tables lack."""

import random
from contextlib import contextmanager

import duckdb
from compare import connect, difference

from strata import catalogue
from strata.operators import decisions, graph, services

SF = "/root/testdata/sf0.001"


@contextmanager
def fixed_plans(spark):
    """Plans that stay as they are made, so that their counts can be read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def rows_made(spark, df, metric: str = "numOutputRows") -> int:
    """The most rows that a node of the plan gave when ``df`` was collected; with another metric the most of that."""

    def most(node) -> int:
        own, below = node.metrics().get(metric), node.children()
        return max([own.get().value() if own.isDefined() else 0, *(most(below.apply(i)) for i in range(below.size()))])

    with fixed_plans(spark):
        df.collect()
        return most(df._jdf.queryExecution().executedPlan())


def test_a_call_meets_a_path_once_however_many_files_offer_it(spark):
    calls = spark.range(300).selectExpr("'a' as service", "concat('http://h/users/', id) as url")
    offered = spark.range(400).selectExpr("'b' as service", "'/users/{id}' as path", "400 - id as ord").unionByName(spark.createDataFrame([("c", "/users/<id>", None), ("c", "/users/<id>", 0)], "service string, path string, ord long"))
    got = services.resolve(calls, offered)
    assert {(r.provider, r.endpoint) for r in got.collect()} == {("c", "/users/<id>")} and got.count() == 300
    assert rows_made(spark, services.resolve(calls, offered)) < 5000


def test_impact_of_a_path_that_many_files_offer(spark):
    calls = spark.range(300).selectExpr("concat('a', id % 2) as service", "concat('http://h/Users/', id) as url")
    offered = spark.range(400).selectExpr("'b' as service", "case when id % 2 = 0 then '/users/{id}' else '/users/{id}/' end as path", "id as ord")
    run = lambda: services.impact(offered, services.resolve(calls, offered))
    assert [(r.service, r.endpoint, r.affected, r.services, r.risk) for r in run().collect()] == [("b", "/users/{id}", 300, ["a0", "a1"], "high")]
    assert rows_made(spark, run()) < 5000


def test_service_map_finds_dependencies_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "b"), ("a", "b")], "service string, provider string").mapInArrow(counted, "service string, provider string")
    m = services.service_map(spark.createDataFrame([("a",), ("b",)], "service string"), spark.createDataFrame([("b",)], "service string"), links)
    assert {tuple(r.asDict().values()) for r in m.selectExpr("service", "n_endpoints", "array_join(depends_on, ',')", "array_join(depended_on_by, ',')").collect()} == {("a", 0, "b,c", ""), ("b", 1, "", "a,c")}
    assert seen.value == 4


def test_upserts_of_ids_that_are_taken(spark, tmp_path):
    con = duckdb.connect()
    for table, key in (("part", "p_partkey"), ("events", "user_id")):
        con.execute(f"copy (select * replace ({key} + n * 1000000 as {key}) from '{SF}/{table}.parquet', range(3) r(n)) to '{tmp_path}/{table}.parquet' (format parquet)")
    for name in ("node_upsert_latest", "session_upsert"):
        assert difference(spark, connect(tmp_path), catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], str(tmp_path)) == ""


def test_modules_of_one_name_ask_for_its_tests_once(spark):
    nodes = spark.range(400).selectExpr("id as node_id", "'module' as kind", "case when id % 2 = 0 then 'm' else 'test_m' end as name", "id % 2 = 1 as is_test")
    edges = spark.createDataFrame([(7, 8, "tests"), (5, 6, "calls")], "source_id long, target_id long, kind string")
    own = nodes.filter("not is_test").select("node_id", "kind", "name")
    assert sorted(r.test_id for r in graph.tests_of(own, nodes, edges).collect()) == list(range(1, 400, 2))
    asked = own.selectExpr("node_id % 4 as request", "node_id", "kind", "name")
    assert {tuple(r) for r in graph.tests_of(asked, nodes, edges).groupBy("request").count().collect()} == {(0, 200), (2, 200)}
    assert rows_made(spark, graph.tests_of(own, nodes, edges)) < 5000


KINDS = "id string, status string, code_anchors array<struct<file_path:string,line_start:bigint,line_end:bigint>>"


def test_overlaps_of_odd_anchors_in_several_blocks(spark, monkeypatch):
    r = random.Random(5)

    def anchor():
        start = r.choice([None, *range(60)])
        end = None if r.random() < 0.2 else r.randrange(80) if start is None else start + r.randrange(-2, 9)
        return (r.choice(["a", "b", "c", None, "d/é", ""]), start, end)

    rows = [(f"D{i:03d}" if i else "Ü", "active", [anchor() for _ in range(r.randrange(9))]) for i in range(90)]
    rows += [("D003", "active", [anchor(), anchor()]), (None, "active", [("a", None, None)]), ("X", "active", None), ("Y", "draft", [("a", None, None)]), ("Z", None, [("a", None, None)])]
    met = lambda x, y: x[0] is not None and x[0] == y[0] and (x[1] is None or y[1] is None or (None not in (x[2], y[2]) and x[1] <= y[2] and y[1] <= x[2]))
    want = {}
    for i, s, xs in rows:
        for j, t, ys in rows:
            if s == t == "active" and i is not None and j is not None and i < j:
                for n, x in enumerate(xs or ()):
                    if any(met(x, y) for y in ys or ()):
                        want.setdefault((i, j), {}).setdefault(n, set()).add(x[0])
    live = spark.createDataFrame(rows, KINDS)
    for held in (decisions.HELD, 50):
        monkeypatch.setattr(decisions, "HELD", held)
        got = [tuple(x) for x in decisions.overlaps(live).collect()]
        assert len(got) == len(set(x[:2] for x in got)) == len(want) > 200
        assert all(f in want[a, b][min(want[a, b])] for a, b, f in got)
    assert decisions.overlaps(live.limit(0)).count() == 0


def test_overlaps_shuffle_decisions_and_not_their_pairs(spark):
    kinds = KINDS.replace("line_end:bigint", "line_end:bigint,content_hash:string") + ", supersedes string"
    live = spark.createDataFrame([(f"D{i:03d}", "active", [("f", None, None, None)], None) for i in range(300)], kinds)
    got = decisions.conflicts(live).filter("kind = 'overlap'")
    assert rows_made(spark, got, "shuffleRecordsWritten") <= 300 * (decisions.SHARES + 1) and got.count() == 300 * 299 // 2
