"""What was served and how it was taken: rollups of context events, benchmarks and feedback.

Frames: ``events(event_id, ts, naive, graph, full_tokens, decisions, contracts, drift, conflicts, dropped, took_ms)``, ``feedback(session_id, ts,
feedback, reason)``, ``sessions(session_id, decisions_provided, contracts_provided)``. Columns that an events table lacks count as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.ranking import placed

SUMS = ("naive", "graph", "full_tokens", "decisions", "contracts", "drift", "conflicts", "dropped")
#: fixed values: what counts as accepted
TAKEN = ("accepted", "modified")
KINDS = ("accepted", "modified", "rejected", "partial")


def reduction(naive: Column, full: Column, digits: int = 1) -> Column:
    """How many in a hundred are saved; nothing to save: 0."""
    return F.when(naive > 0, F.round((1 - full.cast("double") / naive) * 100, digits)).otherwise(F.lit(0.0))


def multiplier(naive: Column, full: Column, digits: int = 1) -> Column:
    return F.when(full > 0, F.round(naive.cast("double") / full, digits)).otherwise(F.lit(0.0))


def _totals(events: DataFrame) -> list[Column]:
    sums = [(F.coalesce(F.sum(c), F.lit(0)) if c in events.columns else F.lit(0)).cast("long").alias(c) for c in SUMS]
    took = F.round(F.coalesce(F.avg("took_ms"), F.lit(0.0)), 1) if "took_ms" in events.columns else F.lit(0.0)
    return [F.count("*").alias("requests"), *sums, took.alias("avg_ms")]


def _saved(totals: DataFrame) -> DataFrame:
    return totals.withColumns({"saved": F.col("naive") - F.col("full_tokens"), "reduction_pct": reduction(F.col("naive"), F.col("full_tokens"))})


def lifetime(events: DataFrame) -> DataFrame:
    """One row of totals, what they save, and the mean time; an empty table gives zeros."""
    return _saved(events.agg(*_totals(events)))


def daily(events: DataFrame) -> DataFrame:
    """:func:`lifetime` a day, ``day`` as text; events without a time are left out."""
    return _saved(events.filter("ts is not null").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(*_totals(events)))


def last_days(daily_rows: DataFrame, days: int = 30) -> DataFrame:
    """The last ``days`` rows by day."""
    return daily_rows.orderBy(F.desc("day")).limit(days)


def recent(rows: DataFrame, key: str, most: int = 20) -> DataFrame:
    """The newest ``most`` rows by ``key``."""
    return rows.orderBy(F.desc(key)).limit(most)


def before_after(events: DataFrame) -> DataFrame:
    """Whole tokens a request before and after, and how many times fewer."""
    t = lifetime(events)
    per = lambda c: F.when(F.col("requests") > 0, F.floor(F.col(c) / F.greatest(F.col("requests"), F.lit(1)))).otherwise(0).cast("long")
    return t.select(per("naive").alias("before_tokens"), per("full_tokens").alias("after_tokens"), multiplier(F.col("naive"), F.col("full_tokens")).alias("multiplier"))


def ratios(events: DataFrame) -> DataFrame:
    """A scenario's savings, a row a row."""
    n, g, f = F.col("naive"), F.col("graph"), F.col("full_tokens")
    return events.select("event_id", reduction(n, g, 2).alias("naive_to_graph"), reduction(n, f, 2).alias("naive_to_full"), multiplier(n, f, 2).alias("multiplier"))


def benchmark(scenarios: DataFrame) -> DataFrame:
    """``scenarios(run, naive, graph, full_tokens)`` -> whole means a run, and the mean reduction of scenarios that had something to save."""
    mean = [F.floor(F.sum(c) / F.count("*")).cast("long").alias(a) for c, a in (("naive", "naive_avg"), ("graph", "graph_avg"), ("full_tokens", "full_avg"))]
    pct = F.avg(F.when(F.col("naive") > 0, (1 - F.col("full_tokens").cast("double") / F.col("naive")) * 100))
    return scenarios.groupBy("run").agg(*mean, F.round(pct, 4).alias("reduction_pct"))


def scenario_files(nodes: DataFrame) -> DataFrame:
    """Files for a benchmark: by the number of their nodes (no tests, nothing generated) the first, a third down, two thirds down, and the last.

    Only places are looked up, after one distributed sort; the table of files is never gathered.
    """
    n = nodes.filter("not is_test and not is_generated").groupBy("file_path").agg(F.count("*").alias("nodes"))
    every = placed(n, F.desc("nodes"), "file_path")
    size = every.agg(F.count("*").alias("size"))
    at = size.select("size", F.explode(F.array_distinct(F.array(F.lit(0), F.floor(F.col("size") / 3), F.floor(2 * F.col("size") / 3), F.col("size") - 1))).alias("place")).filter("size > 0")
    return every.join(F.broadcast(at), "place").select("file_path", "nodes", "place")  # four rows


def rate(kind: Column) -> Column:
    """The share of feedback that was taken, in a hundred."""
    return F.when(F.count("*") > 0, F.round(100.0 * F.count_if(kind.isin(*TAKEN)) / F.greatest(F.count("*"), F.lit(1)), 1)).otherwise(F.lit(0.0)).cast("double")


def acceptance(feedback: DataFrame, since: Column) -> DataFrame:
    """One row ``(total, overall, recent, improvement)``; improvement is told of more than ten."""
    new = F.col("ts") >= since
    n, taken = F.count_if(new), F.count_if(new & F.col("feedback").isin(*TAKEN))
    late = F.when(n > 0, F.round(100.0 * taken / F.greatest(n, F.lit(1)), 1)).otherwise(F.lit(0.0)).cast("double")
    got = feedback.agg(F.count("*").alias("total"), rate(F.col("feedback")).alias("overall"), late.alias("recent"))
    return got.withColumn("improvement", F.when(F.col("total") > 10, F.round(F.col("recent") - F.col("overall"), 1)).otherwise(F.lit(0.0)))


def rejections(feedback: DataFrame) -> DataFrame:
    """``(reason, n, pct)``: in a hundred of all rejections, also those without a reason."""
    own = feedback.filter("feedback = 'rejected'")
    total = own.agg(F.count("*").alias("total"))
    got = own.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).crossJoin(total)  # one row
    return got.select("reason", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).cast("double").alias("pct"))


def acceptance_trend(feedback: DataFrame) -> DataFrame:
    """Counts a day and kind of feedback."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return feedback.groupBy(day).agg(*[F.count_if(F.col("feedback") == k).alias(k) for k in KINDS])


def insights(feedback: DataFrame, since: Column, least: int = 3) -> DataFrame:
    """Reasons rejected ``least`` times and more since then: ``(reason, n, confidence)``."""
    n = feedback.filter(F.col("feedback").eqNullSafe("rejected") & F.col("reason").isNotNull() & (F.col("ts") >= since)).groupBy("reason").agg(F.count("*").alias("n"))
    return n.filter(F.col("n") >= least).select("reason", "n", F.round(F.least(F.lit(0.9), 0.3 + 0.1 * F.col("n")), 2).cast("double").alias("confidence"))


def effectiveness(sessions: DataFrame, feedback: DataFrame) -> DataFrame:
    """``(cohort, sessions, accepted, rate)``: sessions counted once, accepted events each, so that a rate may pass 100."""
    j = sessions.join(feedback, "session_id")
    d, c = F.col("decisions_provided") > 0, F.col("contracts_provided") > 0
    cohorts = F.array_compact(F.array(F.when(d, F.lit("with decisions")), F.when(c, F.lit("with contracts")), F.when(~d & ~c, F.lit("neither"))))
    n = j.select(F.explode(cohorts).alias("cohort"), "session_id", "feedback").groupBy("cohort").agg(F.count_distinct("session_id").alias("sessions"), F.count_if(F.col("feedback").isin(*TAKEN)).alias("accepted"))
    every = sessions.sparkSession.createDataFrame([("with decisions",), ("with contracts",), ("neither",)], "cohort string")
    got = every.join(n, "cohort", "left").fillna(0, ["sessions", "accepted"])
    return got.withColumn("rate", F.when(F.col("sessions") > 0, F.round(100.0 * F.col("accepted") / F.greatest(F.col("sessions"), F.lit(1)), 1)).otherwise(F.lit(0.0)).cast("double"))


def appended(stored: DataFrame, new: DataFrame, event_key: str = "event_id") -> DataFrame:
    """Events after new ones are recorded; one that is there already is left out, so a repeated write adds nothing."""
    return stored.unionByName(new.dropDuplicates([event_key]).join(stored.select(event_key), event_key, "left_anti"), allowMissingColumns=True)


def refreshed(summary: DataFrame, events: DataFrame, days: DataFrame) -> DataFrame:
    """The daily summary with the rows of ``days(day)`` made anew from events; other days stay as they are."""
    touched = F.date_format("ts", "yyyy-MM-dd")
    own = daily(events.withColumn("_day", touched).join(days.select(F.col("day").alias("_day")), "_day", "left_semi").drop("_day"))
    return summary.join(days, "day", "left_anti").unionByName(own, allowMissingColumns=True)


def context_event(items: DataFrame, asked: DataFrame) -> DataFrame:
    """Assembled items -> counters a request: ``(request, items, graph, full_tokens, decisions, contracts, warnings, dropped, truncated)``."""
    took = F.col("taken")
    n = items.groupBy("request").agg(
        F.count_if("taken").alias("items"), F.coalesce(F.sum(F.when(took & (F.col("source") == "graph"), F.col("tokens"))), F.lit(0)).alias("graph"), F.coalesce(F.sum(F.when(took, F.col("tokens"))), F.lit(0)).alias("full_tokens"),
        F.count_if(took & (F.col("item_type") == "decision")).alias("decisions"), F.count_if(took & (F.col("item_type") == "contract_rule")).alias("contracts"), F.count_if(took & (F.col("item_type") == "warning")).alias("warnings"), F.count_if(~took).alias("dropped"),
    )
    return asked.select("request").distinct().join(n, "request", "left").fillna(0).withColumn("truncated", F.col("dropped") > 0)
