"""Queries that run the engine's operators over the driver's tables. Their SQL is in ``plans.answers``, written apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.dialect import SPARK, run
from strata.operators import context, contracts, conventions, decisions, drift, intents, render, services, usage, workspace
from strata.operators.lineage import checkpointed
from strata.sources.records import CONTRACT, INTENT
from strata.sources.relations import with_relations

AS_OF, FEEDBACK_AS_OF = "1999-01-01", "2024-01-29"
#: words of the driver's texts that stand in for decision words, beside the operator's own
WORDS = ("the", "und", "que", "les", "ing")
#: contracts over the driver's documents: id, priority, include, exclude, rules (id, kind, severity, pattern, required pattern, metric, threshold, deadline)
CONTRACTS = (
    ("guard", 100, ("src1/*",), (), (
        ("no-secret", "pattern", "error", r"(password|secret|api_key|token)\s*=\s*", None, None, None, None), ("no-mail", "pattern", "warning", r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+", None, None, None, None),
        ("broken", "pattern", "error", "(", None, None, None, None), ("has-licence", "pattern", "warning", None, "License", None, None, None), ("short-file", "threshold", "warning", None, None, "max_lines", 20.0, None),
    )),
    ("style", 50, (), ("src2/*",), (
        ("no-phone", "pattern", "info", r"\+?[0-9]{2,3}[ -][0-9]{3,4}[ -][0-9]{3,4}", None, None, None, None), ("no-licence-text", "architectural", "info", r"Licensed under|License, Version", None, None, None, "1998-12-21"),
        ("plain-article", "ai_antipattern", "warning", r"\bthe the\b", None, None, None, "2001-01-01"), ("ends-sentence", "pattern", "info", None, r"\.", None, None, None), ("short-file", "threshold", "info", None, None, "max_lines", 30.0, None),
    )),
    ("legacy", 10, ("src?/*",), ("*7.txt",), (("short-function", "threshold", "error", None, None, "max_function_lines", 60.0, None), ("unchecked", "architectural", "error", None, None, None, None, None))),
)
INTENTS = (
    ("INT-001", (("file_exists", "src0/fr/d0.txt"), ("file_contains", "src0/fr/d0.txt::Elle"), ("function_exists", "get_item"), ("wired", "src/api/route_0 -> service"))),
    ("INT-002", (("grep_match", "Licensed under::**/*.txt"), ("grep_no_match", "-----BEGIN::**/*.txt"), ("manual", "look"), ("file_contains", "no mark"), ("test_passes", "pytest"))),
    ("INT-003", ()),
    ("INT-004", (("grep_match", "class Kind1Service"), ("file_exists", "src/core"), ("mcp_tool_exists", "x"))),
)


def rel(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return run(spark, d, with_relations(SPARK, sql))


def _files(spark, d):
    return rel(spark, d, "select path as file_path, content, lang from file")


def _contracts(spark):
    rules = lambda rows: [(i, i, f"about {i}", k, s, p, a, m, v, None, _time(t)) for i, k, s, p, a, m, v, t in rows]
    return spark.createDataFrame([(i, i.title(), None, p, (list(inc), list(exc), [], False, False), rules(r)) for i, p, inc, exc, r in CONTRACTS], CONTRACT)


def _time(day):
    import datetime

    return datetime.datetime.fromisoformat(day) if day else None


def _as_of(day=AS_OF):
    return F.lit(day).cast("timestamp")


def scope_match(spark, d):
    return contracts.applicable(_files(spark, d), _contracts(spark)).select("contract_id", F.col("file_path").alias("path"))


def contracts_by_priority(spark, d):
    return contracts.by_priority(_contracts(spark)).select(F.col("id").alias("contract_id"), "priority", "place")


def contract_guidance(spark, d):
    return contracts.guidance(_files(spark, d).filter("lang = 'en'"), _contracts(spark))


def _found(spark, d, strict=False):
    return contracts.violations(_files(spark, d), _contracts(spark), as_of=AS_OF, strict=strict)


def pattern_violations(spark, d):
    return _found(spark, d).filter("line is not null").select("contract_id", "rule_id", "severity", F.col("file_path").alias("path"), F.col("line").alias("no"), "matched")


def required_pattern(spark, d):
    return _found(spark, d).filter("rule_id in ('has-licence', 'ends-sentence')").select("contract_id", "rule_id", "severity", F.col("file_path").alias("path"))


def max_lines(spark, d):
    return _found(spark, d, strict=True).filter("rule_id = 'short-file'").select("contract_id", "severity", F.col("file_path").alias("path"), "message")


def max_function_lines(spark, d):
    nodes = rel(spark, d, "select * from node").withColumn("file_path", F.concat(F.lit("src1/"), "file_path"))
    files = nodes.select("file_path", F.lit("").alias("content")).distinct()
    return contracts.violations(files, _contracts(spark), nodes, as_of=AS_OF).filter("rule_id = 'short-function'").select("file_path", "line", "message")


def effective_severity(spark, d):
    r = contracts.rules(_contracts(spark))
    made = [contracts.effective_severity(F.col("severity"), F.col("migration_deadline"), _as_of(), strict).alias(c) for strict, c in ((False, "severity"), (True, "strict_severity"))]
    return r.select("contract_id", "rule_id", *made)


def evaluation_rollup(spark, d):
    return contracts.rollup(_found(spark, d)).withColumnRenamed("file_path", "path")


def threshold_conflicts(spark, d):
    return contracts.conflicts(_contracts(spark))


def evaluation_texts(spark, d):
    return render.evaluation(_found(spark, d).filter("contract_id = 'guard'")).withColumnRenamed("file_path", "path")


def rule_precision_vs_labels(spark, d):
    hit = _found(spark, d).filter("line is not null").select("rule_id", "file_path").distinct().join(rel(spark, d, "select path as file_path, doc_id from file"), "file_path")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return hit.join(labels, "doc_id").groupBy("rule_id").agg(F.count("*").alias("labelled"), F.count_if(F.col("quality") == 0).alias("on_low_quality"), F.count_if(F.col("toxic") == 1).alias("on_toxic"))


def conventions_found(spark, d):
    got = conventions.analyze(rel(spark, d, "select file_path, content from code_file"), least=0.3)
    return got.select("name", F.round("confidence", 6).alias("confidence"), "occurrences", "violations", F.array_join("examples", ",").alias("examples"), F.array_join("counter_examples", ",").alias("counter_examples"))


def convention_contract(spark, d):
    c = contracts.draft(conventions.analyze(rel(spark, d, "select file_path, content from code_file"), least=0.3))
    return c.select("id", "priority", F.explode("rules").alias("r"), "scope").select("id", "priority", F.col("r.id").alias("rule_id"), F.col("r.severity").alias("severity"), F.col("scope.exclude_tests").alias("exclude_tests"))


def _journal(spark, d):
    """Decisions with anchors and constraints as records hold them."""
    a = rel(spark, d, "select * from decision_anchor").withColumn("hash", F.when(F.col("anchor") % 8 == 4, F.lit("ffffffffffffffff")).when(F.col("anchor") % 8 == 0, F.lit("e3b0c44298fc1c14")))
    one = F.struct("file_path", "line_start", "line_end", F.lit(None).cast("string").alias("symbol_name"), F.col("hash").alias("content_hash"))
    a = a.groupBy(F.col("decision").alias("num")).agg(F.transform(F.array_sort(F.collect_list(F.struct("anchor", one.alias("a")))), lambda x: x["a"]).alias("code_anchors"))
    j = rel(spark, d, "select d.*, s.id as old from decision d left join decision s on d.supersedes = s.num").join(a, "num", "left")
    rule = F.struct(F.concat(F.lit("keep "), "tag_b").alias("description"), F.col("tag_a").alias("source"), (F.col("num") % 8 == 1).alias("is_hard"), F.expr("cast(date_add(date '1998-01-01', cast(num as int)) as timestamp)").alias("expiry_date"))
    return j.select(
        "id", "num", F.concat(F.lit("Use "), "tag_a").alias("title"), "status", F.col("tag_a").alias("context"), F.col("tag_b").alias("decision"), F.col("old").alias("supersedes"), F.col("review_by").cast("timestamp").alias("review_by"),
        F.array("tag_a", "tag_b").alias("tags"), F.coalesce("code_anchors", F.expr("cast(array() as array<struct<file_path:string,line_start:bigint,line_end:bigint,symbol_name:string,content_hash:string>>)")).alias("code_anchors"),
        F.when(F.col("num") % 4 == 1, F.array(rule)).otherwise(F.array_remove(F.array(rule), rule)).alias("constraints"), F.when(F.col("num") % 3 == 0, F.date_sub("review_by", 400)).cast("timestamp").alias("last_validated"),
    )


def _asked(spark, d):
    return rel(spark, d, "select distinct file_path from node where node_id % 400 = 1")


def _live(spark, d):
    return rel(spark, d, "select distinct file_path, file_path || chr(10) || 'b' || chr(10) || 'c' as content from node where node_id % 3 > 0")


def decision_relevance(spark, d):
    return decisions.relevance(_journal(spark, d), _asked(spark, d))


def decisions_by_tag(spark, d):
    return decisions.by_tags(_journal(spark, d), ["tag1", "tag3"]).select("id")


def anchor_overlap(spark, d):
    return decisions.overlaps(_journal(spark, d))


def supersede_conflicts(spark, d):
    j = _journal(spark, d).withColumn("status", F.when(F.col("num") % 5 < 4, "active").otherwise(F.col("status")))
    return decisions.superseded(j).select(F.col("a_id").alias("newer"), F.col("b_id").alias("older"))


def next_decision_id(spark, d):
    return decisions.next_id(_journal(spark, d))


def decision_drift(spark, d):
    return decisions.drift(_journal(spark, d), _live(spark, d), _as_of()).select("id", "problem", "level", F.when(F.col("problem") == "changed anchor", F.col("file_path")).alias("file_path"))


def decision_drift_for_files(spark, d):
    return decisions.drift_for_files(_journal(spark, d), _asked(spark, d))


def context_rot(spark, d):
    return decisions.rot(_journal(spark, d), _live(spark, d), _as_of())


def _prints(spark, d):
    return (rel(spark, d, f"select path as file_path, hash from {x}") for x in ("live_print", "stored_print"))


def change_classification(spark, d):
    return drift.classify(*_prints(spark, d)).withColumnRenamed("file_path", "path")


def graph_drift(spark, d):
    return drift.graph_drift(*_prints(spark, d)).select(F.col("file_path").alias("path"), "level")


def graph_drift_for_files(spark, d):
    asked = rel(spark, d, "select path as file_path from file where doc_id % 5 < 2 union all select 'none.txt'")
    return drift.graph_drift_for_files(*_prints(spark, d), asked).withColumnRenamed("file_path", "path")


def incremental_plan(spark, d):
    return drift.classify(*_prints(spark, d)).groupBy("state").agg(F.count("*").alias("files"))


def _drifted(spark, d):
    a = decisions.drift(_journal(spark, d), _live(spark, d), _as_of()).select(F.lit("decisions").alias("component"), F.col("id").alias("name"), "problem", "level")
    return a.unionByName(drift.graph_drift(*_prints(spark, d)).select(F.lit("graph").alias("component"), F.col("file_path").alias("name"), "problem", "level"))


def drift_overall(spark, d):
    return drift.overall(_drifted(spark, d))


def drift_report(spark, d):
    return render.drift_report(_drifted(spark, d))


def anchor_region_hash(spark, d):
    return _files(spark, d).select(F.col("file_path").alias("path"), decisions.region_hash(F.col("content"), F.lit(2), F.lit(4)).alias("hash"))


def anchor_shorthand(spark, d):
    return rel(spark, d, "select anchor, file_path, line_start, case when anchor % 3 = 0 then line_start else line_end end as line_end from decision_anchor").select("anchor", decisions.shorthand(F.col("file_path"), F.col("line_start"), F.col("line_end")).alias("short"))


def _intents(spark):
    return spark.createDataFrame([(i, i, None, "active", None, [(f"{k} {v}", k, v, False) for k, v in c]) for i, c in INTENTS], INTENT)


def _checked(spark, d):
    files = rel(spark, d, "select path as file_path, content from file union all select file_path, content from code_file")
    results = spark.createDataFrame([("INT-002", 4, True)], "intent_id string, place int, passed boolean")
    return intents.verify(_intents(spark), files, results)


def criteria_eval(spark, d):
    return _checked(spark, d).select("intent_id", "place", "check_type", "passed")


def intent_rollup(spark, d):
    return intents.rollup(_intents(spark), _checked(spark, d)).select("intent_id", "total", "passed", "failed", "status", "completion_pct", F.array_join(F.transform("gaps", lambda g: g["place"].cast("string")), ",").alias("gaps"))


def intent_texts(spark, d):
    checked = _checked(spark, d)
    return render.intents(intents.rollup(_intents(spark), checked), checked)


def project_routing(spark, d):
    projects = rel(spark, d, "select root, root as project_id from project")
    return workspace.route(_files(spark, d), projects).select(F.col("file_path").alias("path"), "root")


def comment_lines(spark, d):
    lines = _files(spark, d).select("lang", F.explode(F.split("content", "\n", -1)).alias("line"))
    return lines.groupBy("lang").agg(F.count_if(contracts.is_comment(F.col("line"))).alias("comments"), F.count("*").alias("n_lines"))


def language_files(spark, d):
    return _files(spark, d).groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars"))


def decision_texts(spark, d):
    return render.decisions(_journal(spark, d), _as_of())


def contract_texts(spark, d):
    return render.contracts(_contracts(spark)).withColumnRenamed("id", "contract_id")


def freshness(spark, d):
    return _journal(spark, d).select("id", F.round(context.freshness(F.col("review_by"), F.col("last_validated"), F.lit("1998-06-01").cast("timestamp")), 6).alias("freshness"))


def context_decisions(spark, d):
    """Decisions that each asked file's request is offered."""
    requests = _asked(spark, d).select(F.col("file_path").alias("request"), "file_path")
    got = context.decision_items(requests, _journal(spark, d), _as_of())
    return got.select("request", F.col("ref").alias("id"), "priority", F.round("freshness", 6).alias("freshness"))


def context_contracts(spark, d):
    requests = rel(spark, d, "select path as request, path as file_path from file where doc_id < 100")
    return context.contract_items(requests, _contracts(spark)).select("request", F.col("ref").alias("contract_id"), "priority")


# usage


def _events(spark, d):
    return rel(spark, d, "select *, cast(day as timestamp) as ts from context_event")


def _feedback(spark, d):
    return rel(spark, d, "select session_id, cast(day as timestamp) as ts, feedback, reason from feedback_event")


def lifetime_stats(spark, d):
    return usage.lifetime(_events(spark, d))


def daily_summary(spark, d):
    return usage.daily(_events(spark, d))


def daily_trend(spark, d):
    return usage.last_days(usage.daily(_events(spark, d))).select("day", "requests", "saved", "reduction_pct")


def daily_refreshed(spark, d):
    """A summary of half the events, brought up to date for the days that the other half touches."""
    events = _events(spark, d)
    old, days = usage.daily(events.filter("event_id % 2 = 0")), events.filter("event_id % 2 = 1").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    return usage.refreshed(old, events, days)


def before_after(spark, d):
    return usage.before_after(_events(spark, d))


def benchmark_averages(spark, d):
    return usage.benchmark(_events(spark, d).withColumn("run", F.col("event_id") % 50))


def recent_events(spark, d):
    return usage.recent(_events(spark, d), "event_id").select("event_id", "naive", "full_tokens")


def scenario_ratios(spark, d):
    return usage.ratios(_events(spark, d))


def scenario_files(spark, d):
    return usage.scenario_files(rel(spark, d, "select * from node"))


def acceptance_rate(spark, d):
    return usage.acceptance(_feedback(spark, d), F.date_sub(F.lit(FEEDBACK_AS_OF).cast("date"), 7).cast("timestamp"))


def rejection_analysis(spark, d):
    return usage.rejections(_feedback(spark, d))


def acceptance_trend(spark, d):
    return usage.acceptance_trend(_feedback(spark, d))


def repeated_rejection_insights(spark, d):
    return usage.insights(_feedback(spark, d), F.date_sub(F.lit(FEEDBACK_AS_OF).cast("date"), 30).cast("timestamp"))


def context_effectiveness(spark, d):
    return usage.effectiveness(rel(spark, d, "select * from context_session"), _feedback(spark, d))


def effectiveness_text(spark, d):
    return render.effectiveness(context_effectiveness(spark, d))


def benchmark_table(spark, d):
    e = _events(spark, d)
    return render.benchmark(e.withColumn("run", F.col("event_id") % 50).select("run", "event_id", "naive", "graph", "full_tokens").join(usage.ratios(e), "event_id"))


def commit_candidates(spark, d):
    commits = rel(spark, d, "select cast(ord as string) as sha, message, n_files from commit")
    commits = commits.withColumn("files", F.slice(F.transform(F.sequence(F.lit(1), F.greatest("n_files", F.lit(1))), lambda i: F.concat(F.lit("f"), i.cast("string"))), F.lit(1), F.col("n_files").cast("int")))
    return decisions.candidates(commits, WORDS + decisions.KEYWORDS).select("sha", "title", F.size("keywords").alias("hits"), "confidence", F.size("files").alias("n_files"))


# services


def _code(spark, d):
    """Keys dealt out: the texts are made from few bytes of ``part``, so that one task would make, read and match most of them."""
    sql = with_relations(SPARK, "select service, file_path, content, k from service_file")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return run(spark, d, sql.replace("from $part", f"from (select /*+ repartition({n}, p_partkey) */ p_partkey from $part)"))


def _provided(spark, d):
    e = services.endpoints(_code(spark, d)).filter("method = 'GET'").select("service", "path", "file_path").distinct()
    return e.withColumn("ord", F.regexp_extract("file_path", r"([0-9]+)", 1).cast("long"))


def endpoints_extracted(spark, d):
    return services.endpoints(_code(spark, d)).select("service", "file_path", "line", "method", "path", "function").distinct()


def outbound_calls(spark, d):
    return services.outbound_calls(_code(spark, d)).select("service", "file_path", "line", "method", "url", "variable")


def url_path_normalise(spark, d):
    return services.outbound_calls(_code(spark, d)).filter("url is not null").select("url", services.call_path(F.col("url")).alias("path")).distinct()


def service_url_vars(spark, d):
    return services.url_variables(_code(spark, d))


def event_contracts(spark, d):
    return services.events(_code(spark, d)).select("service", "file_path", "event", "direction")


def _depends(spark, d, provided):
    return services.resolve(services.outbound_calls(_code(spark, d)).select("service", "file_path", "url"), provided)


def resolve_dependencies(spark, d):
    return _depends(spark, d, _provided(spark, d)).select("service", "file_path", "provider", "endpoint", "is_critical")


def service_map(spark, d):
    provided = checkpointed(_provided(spark, d))  # used twice
    m = services.service_map(_code(spark, d), provided, _depends(spark, d, provided))
    return m.select("service", "n_endpoints", F.array_join("depends_on", ",").alias("depends_on"), F.array_join("depended_on_by", ",").alias("depended_on_by"))


def cross_service_impact(spark, d):
    provided = checkpointed(_provided(spark, d))  # used twice
    return services.impact(provided, _depends(spark, d, provided)).select("service", "endpoint", "affected", F.array_join("services", ",").alias("services"), "risk")


def service_scan(spark, d):
    return services.scan(_code(spark, d)).select("service", "files", "variables", "events")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scope_match, contracts_by_priority, contract_guidance, pattern_violations, required_pattern, max_lines, max_function_lines, effective_severity, evaluation_rollup, threshold_conflicts, evaluation_texts, rule_precision_vs_labels,
        conventions_found, convention_contract, decision_relevance, decisions_by_tag, anchor_overlap, supersede_conflicts, next_decision_id, decision_drift, decision_drift_for_files, context_rot, change_classification, graph_drift,
        graph_drift_for_files, incremental_plan, drift_overall, drift_report, anchor_region_hash, anchor_shorthand, criteria_eval, intent_rollup, intent_texts, project_routing, comment_lines, language_files, decision_texts, contract_texts,
        freshness, context_decisions, context_contracts, lifetime_stats, daily_summary, daily_trend, daily_refreshed, before_after, benchmark_averages, recent_events, scenario_ratios, scenario_files, acceptance_rate, rejection_analysis, acceptance_trend,
        repeated_rejection_insights, context_effectiveness, effectiveness_text, benchmark_table, commit_candidates, endpoints_extracted, outbound_calls, url_path_normalise, service_url_vars, event_contracts, resolve_dependencies,
        service_map, cross_service_impact, service_scan,
    )
}
