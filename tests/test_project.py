"""The engine on a small project read from disk: graph builds, contracts, conventions, decisions, intents, context."""

import datetime

import pytest
from pyspark.sql import functions as F

from strata.operators import build, context, contracts, conventions, decisions, drift, extract, intents, render
from strata.sources import records, tree

FILES = {
    "src/shop/__init__.py": "from .models import Item\n__all__ = ['Item', \"Base\"]\n",
    "src/shop/models.py": 'from typing import TYPE_CHECKING, Protocol\nif TYPE_CHECKING:\n    from shop.service import sell\n\nclass Base(Protocol):\n    """What all\n    have."""\n\n    x: int\n\nclass Item(Base, metaclass=M):\n    @property\n    def price(self):\n        return 1\n\n    @staticmethod\n    def of():\n        pass\n',
    "src/shop/service.py": 'from shop.models import Item\n@app.get("/items")\nasync def sell(x):\n    """Sells."""\n    password = "x"\n    return x\n\n@overload\ndef sell2(x): ...\n',
    "src/shop/api/route.py": "from shop.service import sell\nimport shop.models\n" + "x = 1\n" * 30,
    "tests/test_service.py": "from shop.service import sell\ndef test_sell():\n    password = 'y'\n",
    "src/gen.py": "# generated by hand\npassword = 1\n",
}


def write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    write(root, FILES)
    return tree.read_tree(spark, str(root)).cache()


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("contracts")
    write(root, {"a.yaml": """
id: safe
name: Safe
priority: 200
scope: {include_patterns: ["src/*", "tests/*"], exclude_tests: true}
rules:
  - {id: no-password, name: No password, description: keep it out, kind: pattern, severity: warning, pattern: "password\\\\s*=", migration_deadline: "2020-01-01"}
  - {id: broken, name: Broken, description: b, kind: pattern, severity: error, pattern: "("}
  - {id: short, name: Short, description: s, kind: threshold, severity: warning, threshold_metric: max_lines, threshold_value: 20}
  - {id: small, name: Small, description: f, kind: threshold, severity: info, threshold_metric: max_function_lines, threshold_value: 3}
  - {id: typed, name: Typed, description: t, kind: ai_antipattern, severity: info, anti_pattern: "^from "}
""", "b.yaml": "id: other\nname: Other\npriority: 5\nscope: {languages: [go]}\nrules: [{id: x, name: X, description: x, kind: pattern, severity: error, pattern: '.'}]\n"})
    return records.read_contracts(spark, str(root)).cache()


def test_python_structure(files):
    got = {r.name: r for r in extract.structured(files).collect() if r.file_path.startswith("src")}
    assert got["Base"].kind == "interface" and got["Base"].docstring == "What all\n    have." and (got["Base"].line_start, got["Base"].line_end) == (5, 9)
    assert got["Item"].superclasses == ["Base"] and got["Item"].line_end == 18
    assert got["price"].is_property and got["of"].is_static and not got["price"].is_static
    assert got["sell"].kind == "endpoint" and got["sell"].is_async and got["sell"].docstring == "Sells." and got["sell"].line_end == 6
    assert "sell2" not in got


def test_full_build(files):
    g = build.full(files)
    name = {r.node_id: f"{r.kind} {r.name}" for r in g.nodes.collect()}
    edges = {(name[r.source_id], name[r.target_id], r.kind, r.is_type_only) for r in g.edges.collect()}
    assert ("class Item", "interface Base", "inherits", False) in edges and ("module models", "module service", "imports", True) in edges
    assert ("module service", "module models", "imports", False) in edges and ("module __init__", "interface Base", "re_exports", False) in edges
    assert g.nodes.count() == len(name) and g.prints.count() == len(FILES)
    p = build.progress(files, g).first()
    assert (p.files, p.processed, p.skipped, p.nodes) == (len(FILES), len(FILES), 0, len(name))


def test_incremental_build_equals_a_full_one(spark, files):
    was = build.full(files)
    changed = {k: v for k, v in FILES.items() if k != "src/gen.py"} | {"src/shop/models.py": FILES["src/shop/models.py"] + "\nclass Extra(Item):\n    pass\n", "src/new.py": "import shop.models\n"}
    now = spark.createDataFrame(list(changed.items()), "file_path string, content string").cache()
    got, want = build.incremental(was, now), build.full(now)
    for a, b in ((got.nodes, want.nodes), (got.edges, want.edges), (got.prints, want.prints)):
        assert sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(b.columns)).collect()))
    same = build.incremental(was, files)
    assert sorted(r.node_id for r in same.nodes.collect()) == sorted(r.node_id for r in was.nodes.collect())
    assert build.stored_path("/p/a/b.py", "/p/a") == "b.py" and build.live_path("b.py", "/p/a/") == "/p/a/b.py" and build.stored_path("/q", "/p") == "/q"


def test_contracts_on_files(files, held):
    g = build.full(files)
    got = {(r.file_path, r.rule_id, r.line, r.severity) for r in contracts.violations(files, held, g.nodes, as_of="2024-01-01").collect()}
    assert got == {("src/shop/service.py", "no-password", 5, "error"), ("src/shop/api/route.py", "short", None, "warning")}
    strict = {(r.rule_id, r.severity) for r in contracts.violations(files, held, as_of="2019-01-01", strict=True).collect()}
    assert strict == {("no-password", "error"), ("short", "error")}
    up = {r.contract_id for r in contracts.guidance(files, held).collect()}
    assert up == {"safe"} and [r.id for r in contracts.by_priority(held).orderBy("place").collect()] == ["safe", "other"]
    text = {r.id: r.text for r in render.contracts(held).collect()}
    assert text["safe"].startswith("## Contract: Safe [safe]\nPriority: 200 | Rules: 5") and "- [WARNING] **No password**: keep it out" in text["safe"]
    assert contracts.violations(files.limit(0), held).count() == 0 and contracts.violations(files, held.limit(0)).count() == 0
    null = files.select("file_path", F.lit(None).cast("string").alias("content"))
    assert {r.rule_id for r in contracts.violations(null, held.filter("id = 'other'")).collect()} == {"unreadable"}


def test_project_contracts_override_builtins(held):
    own = held.withColumn("name", F.lit("mine")).filter("id = 'safe'")
    twice = own.unionByName(own.withColumns({"name": F.lit("last"), "file_path": F.lit("z.yaml")}))
    assert {(r.id, r.name) for r in contracts.merged(held, twice).collect()} == {("safe", "last"), ("other", "Other")}


def test_globs_and_scope(spark):
    from strata.functions import glob

    rows = [("src/a/b.py", "src/*.py", True), ("a.pyc", "*.py", False), ("x[1].js", "x?1?.js", True), ("ab", "[!b]b", True), ("b.min.js", "*.min.js", True), ("a+b", "a+b", True)]
    got = spark.createDataFrame(rows, "p string, g string, want boolean").select("want", glob.matches(F.col("p"), F.col("g")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_conventions(spark):
    rows = [(f"src/api/route_{i}.py", "@router.get('/')\nasync def get_x():\n    raise AppError('x')\n") for i in range(4)] + [("src/api/route_9.py", "from models import X\n@router.get('/')\ndef get_x(): pass\n")]
    f = spark.createDataFrame(rows, "file_path string, content string")
    got = {r.name: r for r in conventions.analyze(f).collect()}
    assert got["Async handlers"].occurrences == 4 and got["Async handlers"].counter_examples == ["src/api/route_9.py"] and got["Async handlers"].examples == [f"src/api/route_{i}.py" for i in range(3)]
    assert got["Layer separation"].confidence == 0.8 and got["Custom exceptions"].violations == 0
    c = contracts.draft(conventions.analyze(f)).first()
    assert c.priority == 150 and c.scope.exclude_tests and [r.id for r in c.rules] == ["auto-async-handlers", "auto-no-bare-except", "auto-no-db-in-routes"]
    assert conventions.analyze(f.limit(0)).count() == 0


def journal(spark):
    day = lambda *x: datetime.datetime(*x)
    anchor = lambda p, a=None, b=None, h=None: (p, a, b, None, h)
    rows = [
        ("DEC-001", "One", "active", None, day(2020, 1, 1), ["a"], [anchor("src/shop/service.py", 1, 3)], [("keep", "law", True, day(2019, 1, 1))]),
        ("DEC-002", "Two", "active", "DEC-001", None, ["b"], [anchor("src/shop/service.py", 3, 9), anchor("src/gone.py")], []),
        ("DEC-003", "Three", "superseded", None, None, ["a"], [anchor("src/shop/service.py")], None),
        ("DEC-004", "Four", "active", None, day(2999, 1, 1), [], [], []),
        ("DEC-005", "Five", "active", None, None, [], [anchor("src/shop/models.py", 1, 1, "0" * 16)], []),
    ]
    rows = [(*r[:2], r[2], "why", "what", *r[3:]) for r in rows]
    return spark.createDataFrame(rows, "id string, title string, status string, context string, decision string, supersedes string, review_by timestamp, tags array<string>, code_anchors array<struct<file_path:string,line_start:int,line_end:int,symbol_name:string,content_hash:string>>, constraints array<struct<description:string,source:string,is_hard:boolean,expiry_date:timestamp>>")


def test_decisions(spark, files):
    j, now = journal(spark), F.lit("2024-01-01").cast("timestamp")
    asked = spark.createDataFrame([("src/shop/service.py",)], "file_path string")
    assert {(r.id, r.score) for r in decisions.relevance(j, asked).collect()} == {("DEC-001", 1.0), ("DEC-002", 1.0), ("DEC-004", 0.1), ("DEC-005", 0.5)}
    assert [r.id for r in decisions.by_files(j, asked, most=2).orderBy("place").collect()] == ["DEC-001", "DEC-002"]
    assert {tuple(r) for r in decisions.conflicts(j).collect()} == {("superseded", "DEC-002", "DEC-001", None), ("overlap", "DEC-001", "DEC-002", "src/shop/service.py")}
    got = {(r.id, r.problem, r.level) for r in decisions.drift(j, files, now).collect()}
    assert got == {("DEC-001", "stale", "medium"), ("DEC-001", "expired constraint", "high"), ("DEC-002", "orphaned anchor", "medium"), ("DEC-005", "changed anchor", "medium")}
    assert tuple(decisions.rot(j, files, now).first()) == (5, 1, 1, True)
    assert decisions.next_id(j).first()[0] == "DEC-006" and decisions.next_id(j.limit(0)).first()[0] == "DEC-001"
    short = {r.id: r.code_anchors for r in decisions.with_shorthand(j).collect()}
    assert short["DEC-002"] == ["src/shop/service.py:3-9", "src/gone.py"] and short["DEC-005"] == ["src/shop/models.py:1"]
    assert {r.id for r in decisions.by_tags(j, ["a", "z"]).collect()} == {"DEC-001", "DEC-003"}
    assert decisions.saved(j, j.limit(1).withColumn("title", F.lit("New"))).filter("title = 'New'").count() == 1


def test_commits(spark):
    rows = [("a1", "Merge branch x\nbecause", ["f"]), ("b2", "  Switched to parquet because it is small\n\nLong text", [f"f{i}" for i in range(30)]), ("c3", "nothing here", []), ("d4", None, None), ("e5", "x" * 90 + " adr", ["f"])]
    got = {r.sha: r for r in decisions.candidates(spark.createDataFrame(rows, "sha string, message string, files array<string>")).collect()}
    assert set(got) == {"b2", "e5"} and got["b2"].keywords == ["switched to", "because"] and got["b2"].context == "Long text"
    assert len(got["b2"].files) == 20 and len(got["b2"].anchors) == 10 and got["b2"].confidence == 0.5 and len(got["e5"].title) == 80 and got["e5"].confidence == 0.55
    draft = decisions.drafts(decisions.candidates(spark.createDataFrame(rows, "sha string, message string, files array<string>"))).filter("id = 'MINED-b2'").first()
    assert draft.status == "draft" and draft.code_anchors[0].file_path == "f0"


def test_drift_checks(spark, files):
    j, stored = journal(spark), drift.fingerprints(files)
    live = files.filter("file_path <> 'src/gen.py'").withColumn("content", F.when(F.col("file_path") == "src/shop/models.py", "x").otherwise(F.col("content")))
    got = {(r.component, r.name, r.problem, r.level) for r in drift.full_check(j, live, stored, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert {("graph", "src/gen.py", "deleted", "high"), ("graph", "src/shop/models.py", "changed", "medium"), ("journal", "decisions", "much of it is stale or orphaned", "high")} <= got and len(got) == 7
    asked = spark.createDataFrame([("src/shop/models.py",), ("src/shop/service.py",), ("new.py",)], "file_path string")
    more = live.select("file_path", "content").unionByName(spark.createDataFrame([("new.py", "n")], "file_path string, content string"))
    got = {(r.component, r.name, r.level) for r in drift.check_files(j, more, stored, asked).collect()}
    assert got == {("graph", "new.py", "low"), ("graph", "src/shop/models.py", "none"), ("decisions", "DEC-001", "low"), ("decisions", "DEC-002", "low"), ("decisions", "DEC-005", "low")}
    assert render.drift_report(spark.createDataFrame([], "component string, name string, problem string, level string")).count() == 0
    import xxhash

    assert {r.file_path: r.hash for r in stored.collect()}["src/gen.py"] == xxhash.xxh64_hexdigest(FILES["src/gen.py"].encode())


def test_intents_are_saved_with_their_results(spark, files):
    rows = [("I1", "One", "active", [("a", "function_exists", "sell", False), ("b", "wired", "route -> service", False), ("c", "grep_no_match", "password::src/*.py", False), ("d", "cli_works", "x", False)]), ("I2", "Two", "active", [])]
    i = spark.createDataFrame(rows, "id string, title string, status string, criteria array<struct<description:string,check_type:string,check_value:string,satisfied:boolean>>")
    checked = intents.verify(i, files)
    assert [(r.place, r.passed) for r in checked.orderBy("place").collect()] == [(0, True), (1, True), (2, False), (3, False)]
    saved = {r.id: r for r in intents.with_results(i, checked).collect()}
    assert saved["I1"].status == "partial" and [c.satisfied for c in saved["I1"].criteria] == [True, True, False, False] and saved["I2"].status == "active"
    assert {r.id for r in intents.open_intents(intents.with_results(i, checked), "partial").collect()} == {"I1"}


def test_assembled_context(spark, files, held):
    g = build.full(files)
    requests = spark.createDataFrame([("r1", "src/shop/service.py"), ("r2", "nowhere.py")], "request string, file_path string")
    now = F.lit("2024-01-01").cast("timestamp")
    items = context.graph_items(requests, g.nodes, g.edges, files).unionByName(context.decision_items(requests, journal(spark), now)).unionByName(context.contract_items(requests, held)).cache()
    got = {(r.request, r.item_type, r.priority) for r in items.collect()}
    assert {("r1", "file_content", "critical"), ("r1", "file_content", "high"), ("r1", "decision", "high"), ("r1", "contract_rule", "medium"), ("r2", "warning", "high"), ("r2", "decision", "low")} <= got
    stale = items.filter("ref = 'DEC-001'").first()
    assert stale.freshness == 0.3 and "**Review was due on 2020-01-01**" in stale.content and "- [MUST] keep (source: law)" in stale.content
    taken = context.assemble(items, 5000).cache()
    assert taken.filter("not taken").count() == 0
    said = [tuple(r)[:3] for r in context.contradictions(taken, decisions.anchors(journal(spark))).collect()]
    assert said == [("r1", "DEC-001", "safe")]
    tight = context.assemble(items, 30).filter("request = 'r1' and taken").collect()
    assert [r.priority for r in tight] == ["critical"] and tight[0].content.endswith(context.MARKER) and tight[0].tokens <= 30
    assert context.assemble(items, 0).filter("taken").count() == 0
    naive = {r.request: r.tokens for r in context.naive_tokens(requests, files).collect()}
    assert naive["r2"] == 0 and naive["r1"] == sum(-(-len(t) // 4) for p, t in FILES.items() if p.startswith("src/shop/") and "/api/" not in p)
