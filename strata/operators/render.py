"""Records, reports and insights as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators import drift
from strata.operators.context import decision_text

#: entries of a component that a drift report shows
SHOWN = 10


def decisions(journal: DataFrame, as_of: Column, verbose: bool = True) -> DataFrame:
    """``(id, text)``, a row a decision."""
    return journal.select("id", decision_text(as_of, F.lit(verbose)).alias("text"))


def contracts(held: DataFrame) -> DataFrame:
    """``(id, text)``, a row a contract: its rules with severity and what to do about them."""
    each = F.transform("rules", lambda r: F.concat(F.lit("- ["), F.upper(r["severity"]), F.lit("] **"), r["name"], F.lit("**: "), F.coalesce(r["description"], F.lit("")), F.coalesce(F.concat(F.lit(" Fix: "), r["fix_suggestion"]), F.lit(""))))
    head = F.concat(F.lit("## Contract: "), "name", F.lit(" ["), "id", F.lit("]\nPriority: "), F.col("priority").cast("string"), F.lit(" | Rules: "), F.size("rules").cast("string"), F.lit("\n"))
    return held.select("id", F.concat_ws("\n", head, F.nullif(F.array_join(each, "\n"), F.lit(""))).alias("text"))


def evaluation(found: DataFrame) -> DataFrame:
    """Violations as one text a file: the count of each severity, then the violations by line."""
    row = F.struct(F.coalesce("line", F.lit(0)).alias("line"), "rule_id", "severity", "message")
    n = found.groupBy("file_path").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.array_sort(F.collect_list(row)).alias("v"))
    each = F.transform("v", lambda v: F.concat(F.lit("- ["), F.upper(v["severity"]), F.lit("] "), v["rule_id"], F.when(v["line"] > 0, F.concat(F.lit(" (line "), v["line"].cast("string"), F.lit(")"))).otherwise(F.lit("")), F.lit(": "), v["message"]))
    head = F.concat(F.lit("## "), "file_path", F.lit("\n"), F.col("errors").cast("string"), F.lit(" errors, "), F.col("warnings").cast("string"), F.lit(" warnings"))
    return n.select("file_path", F.concat_ws("\n", head, F.array_join(each, "\n")).alias("text"))


def drift_report(items: DataFrame) -> DataFrame:
    """One text of ``items(component, name, problem, level)``: the worst level, then a component's first entries and how many are left out.

    Only the entries shown are gathered.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("component").orderBy("name", "problem", "level")
    shown = items.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= SHOWN)
    line = F.concat(F.lit("- ["), "level", F.lit("] "), "name", F.lit(": "), "problem")
    listed = shown.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("t")))), lambda x: x["t"]), "\n").alias("listed"))
    sizes = items.groupBy("component").agg(F.count("*").alias("n"), F.max(drift.rank(F.col("level"))).alias("worst"))
    more = F.when(F.col("n") > SHOWN, F.concat(F.lit("- and "), (F.col("n") - SHOWN).cast("string"), F.lit(" others")))
    part = F.concat_ws("\n", F.concat(F.lit("### "), "component"), "listed", more)
    every = listed.join(sizes, "component").agg(F.max("worst").alias("worst"), F.array_sort(F.collect_list(F.struct("component", part.alias("t")))).alias("p"))
    level = F.element_at(F.array(*[F.lit(x) for x in drift.LEVELS]), (F.col("worst") + 1).cast("int"))
    return every.filter("worst is not null").select(F.concat(F.lit("## Drift\nWorst level: "), level, F.lit("\n"), F.array_join(F.transform("p", lambda x: x["t"]), "\n")).alias("text"))


def intents(rolled: DataFrame, checked: DataFrame) -> DataFrame:
    """``(intent_id, text)``: status and progress, then each criterion, and what an intent still lacks."""
    row = F.struct("place", F.concat(F.lit("- ["), F.when(F.col("passed"), "x").otherwise(" "), F.lit("] "), F.coalesce("description", F.lit(""))).alias("t"))
    listed = checked.groupBy("intent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), "\n").alias("listed"))
    head = F.concat(F.lit("## Intent: "), "intent_id", F.lit("\nStatus: "), "status", F.lit(" | "), F.col("passed").cast("string"), F.lit("/"), F.col("total").cast("string"))
    lacks = F.when(F.col("failed") > 0, F.concat(F.lit("Not done: "), F.col("failed").cast("string"), F.lit(" to go")))
    return rolled.join(listed, "intent_id", "left").select("intent_id", F.concat_ws("\n", head, "listed", lacks).alias("text"))


def service_map(mapped: DataFrame) -> DataFrame:
    """``(service, text)`` of ``services.service_map``."""
    say = lambda word, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n  {word}: "), F.array_join(c, ", "))).otherwise(F.lit(""))
    return mapped.select("service", F.concat("service", F.lit(": "), F.col("n_endpoints").cast("string"), F.lit(" endpoints"), say("calls", "depends_on"), say("called by", "depended_on_by")).alias("text"))


def benchmark(scenarios: DataFrame) -> DataFrame:
    """``scenarios(run, event_id, naive, graph, full_tokens, naive_to_full, multiplier)`` -> ``(run, text)``: a markdown table a run, with means below."""
    cells = ["event_id", F.format_number("naive", 0), F.format_number("graph", 0), F.format_number("full_tokens", 0), F.concat(F.format_number("naive_to_full", 0), F.lit("%")), F.concat(F.format_number("multiplier", 1), F.lit("x"))]
    row = F.struct("event_id", F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cells]), F.lit(" |")).alias("t"))
    got = scenarios.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), "\n").alias("rows"), F.avg("naive_to_full").alias("pct"), F.avg("multiplier").alias("times"))
    head = F.lit("| Scenario | Naive Tokens | Graph Tokens | Full Tokens | Reduction | Multiplier |\n|---|---:|---:|---:|---:|---:|")
    mean = F.concat(F.lit("| **Average** | | | | **"), F.format_number("pct", 0), F.lit("%** | **"), F.format_number("times", 1), F.lit("x** |"))
    return got.select("run", F.concat_ws("\n", head, "rows", mean).alias("text"))


def effectiveness(cohorts: DataFrame, least: int = 5, apart: float = 5.0) -> DataFrame:
    """One text of ``usage.effectiveness``: by how much cohorts differ; cohorts of fewer than ``least`` sessions tell nothing."""
    pick = [F.max(F.when(F.col("cohort") == c, F.col(x))).alias(f"{x[0]}_{k}") for c, k in (("with decisions", "d"), ("with contracts", "c"), ("neither", "n")) for x in ("sessions", "accepted")]
    rate = lambda k: 100.0 * F.col(f"a_{k}") / F.greatest(F.col(f"s_{k}"), F.lit(1))
    enough = (F.col("s_d") >= least) & (F.col("s_n") >= least) & (rate("d") - rate("n") > apart)
    said = F.concat_ws(
        " ", F.when(enough, F.concat(F.lit("Decisions raise acceptance by "), F.round(rate("d") - rate("n")).cast("int").cast("string"), F.lit(" points."))), F.when(F.col("s_c") >= least, F.concat(F.lit("With contracts acceptance is "), F.round(rate("c")).cast("int").cast("string"), F.lit(" in a hundred.")))
    )
    return cohorts.agg(*pick).select(F.coalesce(F.nullif(said, F.lit("")), F.lit("Too few sessions to tell.")).alias("text"))
