"""Workspace, services and usage operators on small tables."""

import datetime

from pyspark.sql import functions as F

from strata.operators import services, usage, workspace


def test_workspace(spark):
    files = spark.createDataFrame([("/a/b/c/x.py",), ("/a/y.py",), ("/z.py",)], "file_path string")
    t = lambda d: datetime.datetime(2024, 1, d)
    kinds = "project_id string, name string, root string, registered_at timestamp, last_accessed timestamp"
    p = spark.createDataFrame([("p", "P", "/a", t(1), t(1)), ("q", "Q", "/a/b", t(2), t(2))], kinds)
    assert {tuple(r) for r in workspace.route(files, p).collect()} == {("/a/b/c/x.py", "q", "/a/b"), ("/a/y.py", "p", "/a"), ("/z.py", None, None)}
    entries = spark.createDataFrame([("/a/.git",), ("/a/b/c/pyproject.toml",), ("/package.json",)], "path string")
    assert {tuple(r) for r in workspace.discover(files, entries).collect()} == {("/a/b/c/x.py", "/a/b/c"), ("/a/y.py", "/a"), ("/z.py", None)}
    new = spark.createDataFrame([("p", "New", "/n", t(9), t(9)), ("r", "R", "/r", t(9), t(9))], kinds)
    got = {r.project_id: r for r in workspace.register(p, new).collect()}
    assert got["p"].name == "New" and got["p"].registered_at == t(1) and set(got) == {"p", "q", "r"}
    assert {r.project_id for r in workspace.unregister(p, new).collect()} == {"q"}
    seen = spark.createDataFrame([(x, t(d)) for x, d in (("p", 5), ("q", 1), ("a", 2), ("b", 3), ("c", 4), ("d", 6))], "project_id string, at timestamp")
    assert {r.project_id: r.last_accessed for r in workspace.touch(p, seen).collect()} == {"p": t(5), "q": t(2)}
    assert {r.project_id for r in workspace.held(seen).collect()} == {"p", "a", "b", "c", "d"}


SOURCE = """@app.get("/api/users/{id}")
async def user(id): pass
router.post('/pay', pay)
@GetMapping("/j")
r = requests.get(f"{BASE}/orders/9?x")
fetch(`http://h/api/v1/a`)
y = client.get(target)
base_url = "http://x/api/v2"
os.environ("PAY_URL")
bus.publish("paid")
"""


def test_services(spark):
    f = spark.createDataFrame([("s", "a.py", SOURCE), ("t", "b.py", None)], "service string, file_path string, content string")
    e = {(r.line, r.method, r.path, r.function) for r in services.endpoints(f).collect()}
    assert {(1, "GET", "/api/users/{id}", "user"), (3, "POST", "/pay", ""), (4, "GET", "/j", "")} <= e
    c = {(r.line, r.method, r.url, r.variable) for r in services.outbound_calls(f).collect()}
    assert {(5, "GET", "{BASE}/orders/9?x", None), (6, "ANY", "http://h/api/v1/a", None), (7, "GET", None, "target"), (8, "ANY", "http://x/api/v2", None)} <= c
    assert {tuple(r) for r in services.url_variables(f).collect()} >= {("s", "PAY_URL")}
    assert {(r.event, r.direction) for r in services.events(f).collect()} == {("paid", "publishes")}
    urls = spark.createDataFrame([("http://h:8/a/b/",), ("{X}/orders/1",), ("/{v}/c/{id}",), ("http://h",), (None,)], "u string")
    assert [r[0] for r in urls.select(services.call_path(F.col("u"))).collect()] == ["/a/b", "/orders/1", "/c/{id}", None, None]


def test_resolution(spark):
    calls = spark.createDataFrame([("a", "http://b/Users/7"), ("a", "/login"), ("b", "/users/7"), ("a", "/users/7/x"), ("a", "/q.z"), ("c", "/any/thing")], "service string, url string")
    e = spark.createDataFrame([("b", "/users/{id}", 2), ("c", "/users/<id>/", 1), ("b", "/login", 3), ("b", "/qxz", 4), ("b", "/{a}/{b}", 9)], "service string, path string, ord long")
    got = {(r.service, r.url, r.provider, r.endpoint, r.is_critical) for r in services.resolve(calls, e).collect()}
    assert got == {("a", "http://b/Users/7", "c", "/users/<id>/", False), ("a", "/login", "b", "/login", True), ("b", "/users/7", "c", "/users/<id>/", False), ("c", "/any/thing", "b", "/{a}/{b}", False)}
    i = {r.endpoint: (r.affected, r.risk, r.services) for r in services.impact(e, services.resolve(calls, e)).collect()}
    assert i["/login"] == (1, "critical", ["a"]) and i["/users/<id>/"] == (2, "medium", ["a", "b"])
    m = {r.service: (r.n_endpoints, r.depends_on, r.depended_on_by) for r in services.service_map(calls.select("service"), e, services.resolve(calls, e)).collect()}
    assert m["a"] == (0, ["b", "c"], []) and m["b"] == (4, ["c"], ["a", "c"])
    assert services.resolve(calls.limit(0), e).count() == 0 == services.resolve(calls, e.limit(0)).count()


def test_usage_of_empty_and_odd_tables(spark):
    kinds = "event_id long, ts timestamp, naive long, graph long, full_tokens long"
    none = spark.createDataFrame([], kinds)
    assert usage.lifetime(none).first().asDict() == {"requests": 0, "naive": 0, "graph": 0, "full_tokens": 0, "decisions": 0, "contracts": 0, "drift": 0, "conflicts": 0, "dropped": 0, "avg_ms": 0.0, "saved": 0, "reduction_pct": 0.0}
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), 100, None, 40), (2, None, 0, 5, 5), (1, None, 9, 9, 9)], kinds)
    assert usage.daily(rows).select("day", "requests", "reduction_pct").collect() == [("2024-01-01", 1, 60.0)]
    assert usage.appended(rows.limit(1), rows).count() == 2 and usage.before_after(none).first().multiplier == 0.0
    assert usage.acceptance(spark.createDataFrame([], "ts timestamp, feedback string"), F.lit("2024-01-01").cast("timestamp")).first().overall == 0.0


def test_builtin_contracts_and_packs(spark, tmp_path):
    from strata.operators import contracts
    from strata.sources import builtin, collect

    own = {r.id: r for r in builtin.builtin_contracts(spark).collect()}
    assert {k: (v.priority, len(v.rules)) for k, v in own.items()} == {"ai-guardrails": (500, 6), "architecture-basics": (400, 3)}
    assert {r.id: len(r.rules) for r in builtin.rule_packs(spark).collect()} == {"fastapi-conventions": 10, "react-typescript": 11, "nodejs-express": 12}
    f = spark.createDataFrame([("src/a.py", "import requests\nx = requests.get('u')\nh = UserService()\n"), ("src/tests/b.py", "time.sleep(1)\n"), ("src/c.py", "x\n" * 600 + "y = 1 # set it\n")], "file_path string, content string")
    every = contracts.merged(builtin.builtin_contracts(spark), builtin.rule_packs(spark, "fastapi-conventions").withColumn("file_path", F.lit("f.yaml")))
    got = {(r.file_path, r.rule_id) for r in contracts.violations(f, every).collect()}
    assert got == {("src/a.py", "async-everywhere"), ("src/a.py", "use-depends"), ("src/c.py", "no-god-files"), ("src/c.py", "no-restating-comments")}
    t = datetime.datetime(2024, 1, 1)
    p = spark.createDataFrame([("p", "P", "/a", t, None)], collect.PROJECT)
    collect.write_registry(p, f"{tmp_path}/r")
    assert collect.read_registry(spark, f"{tmp_path}/r").collect() == p.collect() and collect.lookup(p, "project_id", "p").count() == 1
    for name, text in (("a.py", "x"), ("b.go", "y"), ("c.txt", "z"), ("d.ts", "w" * 500_001)):
        (tmp_path / "repo").mkdir(exist_ok=True)
        (tmp_path / "repo" / name).write_text(text)
    assert {r.file_path for r in collect.convention_files(spark, f"{tmp_path}/repo").collect()} == {"a.py"}
    assert {(r.service, r.file_path) for r in collect.service_files(spark, f"{tmp_path}/repo", "s").collect()} == {("s", "a.py"), ("s", "b.go")}


def test_records_name_known_kinds_alone(spark, tmp_path):
    from strata.functions.dates import as_utc
    from strata.sources import records

    (tmp_path / "c.yaml").write_text("id: c\nrules: [{id: a, kind: AI-Antipattern, severity: ERROR}, {id: b, kind: odd}, text]\n")
    c = records.read_contracts(spark, str(tmp_path)).first()
    assert [(r.id, r.kind, r.severity) for r in c.rules] == [("a", "ai_antipattern", "error"), ("b", "pattern", "warning")] and c.priority == 100
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "i.yaml").write_text("id: i\nstatus: Strange\ncriteria: [look at it, {description: d, type: Grep-Match, check: x}]\n")
    (tmp_path / "i" / "empty.yaml").write_text("")
    i = records.read_intents(spark, f"{tmp_path}/i").collect()
    assert len(i) == 1 and i[0].status == "active" and [(x.description, x.check_type, x.check_value) for x in i[0].criteria] == [("look at it", "manual", None), ("d", "grep_match", "x")]
    records.write_records(spark.createDataFrame([("i", "T", [("d", True)])], "id string, title string, criteria array<struct<description:string,satisfied:boolean>>"), f"{tmp_path}/out")
    assert records.read_intents(spark, f"{tmp_path}/out").first().criteria[0].satisfied
    t = spark.createDataFrame([("2024-01-01",), ("2024-01-01T02:00:00",), ("2024-01-01T02:00:00+02:00",), ("soon",), (None,)], "t string")
    hour = lambda h: datetime.datetime(2024, 1, 1, h)
    assert [r[0] for r in t.select(as_utc(F.col("t"))).collect()] == [hour(0), hour(2), hour(0), None, None]
