"""Drift of a stored graph against live files, and how records of drift roll up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.hashing import xxh64
from strata.operators import decisions as decided

#: fixed values: levels in rising order
LEVELS = ("none", "low", "medium", "high", "critical")


def fingerprints(files: DataFrame) -> DataFrame:
    """``(file_path, hash)``: XXH64 of the content with seed 0 (16 hex digits), null content as empty."""
    return files.select("file_path", xxh64("content").alias("hash"))


def classify(live: DataFrame, stored: DataFrame) -> DataFrame:
    """``live(file_path, hash)`` and ``stored(file_path, hash)`` -> ``(file_path, state)``: new, same, changed or deleted."""
    l, s = live.select("file_path", F.col("hash").alias("now"), F.lit(1).alias("l")), stored.select("file_path", F.col("hash").alias("was"), F.lit(1).alias("s"))
    state = F.when(F.col("l").isNull(), "deleted").when(F.col("s").isNull(), "new").when(F.col("now").eqNullSafe(F.col("was")), "same").otherwise("changed")
    return l.join(s, "file_path", "full").select("file_path", state.alias("state"))


def graph_drift(live: DataFrame, stored: DataFrame) -> DataFrame:
    """``(file_path, problem, level)``: deleted files (high) and changed ones (medium); new files are no drift."""
    c = classify(live, stored).filter(F.col("state").isin("deleted", "changed"))
    return c.select("file_path", F.col("state").alias("problem"), F.when(F.col("state") == "deleted", "high").otherwise("medium").alias("level"))


def graph_drift_for_files(live: DataFrame, stored: DataFrame, asked: DataFrame) -> DataFrame:
    """Of the files asked for that are there: ``(file_path, problem, level)`` of those never indexed (low) and those changed (none: only counted)."""
    own = asked.select("file_path").distinct()
    c = classify(live.join(own, "file_path", "left_semi"), stored.join(own, "file_path", "left_semi")).filter(F.col("state").isin("new", "changed"))
    return c.select("file_path", F.when(F.col("state") == "new", "unknown").otherwise("changed").alias("problem"), F.when(F.col("state") == "new", "low").otherwise("none").alias("level"))


def rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) - 1


def overall(items: DataFrame) -> DataFrame:
    """``(level, items, overall)`` of ``items(level)``, by level's name; ``overall`` is the highest. No items: no rows."""
    n = items.filter("level <> 'none'").groupBy("level").agg(F.count("*").alias("items"))
    top = n.agg(F.max_by("level", rank(F.col("level"))).alias("overall"))
    return n.crossJoin(top)  # one row


def full_check(decisions: DataFrame, files: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """All drift: ``(component, name, problem, level)`` of the graph, of decisions, and of the whole journal if it rots."""
    g = graph_drift(fingerprints(files), stored).select(F.lit("graph").alias("component"), F.col("file_path").alias("name"), "problem", "level")
    d = decided.drift(decisions, files, as_of).select(F.lit("decisions").alias("component"), F.col("id").alias("name"), "problem", "level")
    r = decided.rot(decisions, files, as_of).filter("rot").select(F.lit("journal").alias("component"), F.lit("decisions").alias("name"), F.lit("much of it is stale or orphaned").alias("problem"), F.lit("high").alias("level"))
    return g.unionByName(d).unionByName(r)


def check_files(decisions: DataFrame, files: DataFrame, stored: DataFrame, asked: DataFrame) -> DataFrame:
    """Drift that a change of the files asked for may bring: ``(component, name, problem, level)``."""
    g = graph_drift_for_files(fingerprints(files), stored, asked).select(F.lit("graph").alias("component"), F.col("file_path").alias("name"), "problem", "level")
    d = decided.drift_for_files(decisions, asked).select(F.lit("decisions").alias("component"), F.col("id").alias("name"), F.concat(F.lit("anchored in "), "file_path").alias("problem"), "level")
    return g.unionByName(d)
