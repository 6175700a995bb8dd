"""Intents: whether their acceptance criteria hold over a project's files.

``intents(id, title, status, criteria array<struct<description, check_type, check_value, ...>>)``; ``files(file_path, content)``.
Kinds that run a command are not evaluated here: their results come in as ``results(intent_id, place, passed)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: kinds of checks that read files, and kinds that run something
READ_KINDS = ("file_exists", "file_contains", "function_exists", "wired", "mcp_tool_exists", "grep_match", "grep_no_match")
RUN_KINDS = ("cli_works", "test_passes", "custom")
#: fixed values: folders that searches leave out, and what they search unless told otherwise
SKIPPED = r"(^|/)(node_modules|\.venv|__pycache__|\.git)(/|$)"
DEFAULT_GLOB = "**/*.py"
#: most criteria that are checked in one pass over the files
CRITERIA = 5_000


def criteria(intents: DataFrame) -> DataFrame:
    """``(intent_id, place, description, check_type, check_value)``, a row a criterion."""
    c = intents.select(F.col("id").alias("intent_id"), F.posexplode("criteria").alias("place", "c"))
    return c.select("intent_id", "place", "c.description", "c.check_type", "c.check_value")


def _two(value: Column, mark: str) -> tuple[Column, Column]:
    """What stands before and after the first ``mark``; without it the second is null."""
    at = F.instr(value, mark)
    return F.trim(F.when(at > 0, F.substring(value, F.lit(1), at - 1)).otherwise(value)), F.when(at > 0, F.trim(F.substring(value, at + len(mark), F.length(value))))


def as_glob(path: Column, pattern: Column) -> Column:
    """Whether a path matches a glob whose ``**/`` stands for any folders or none, and whose ``*`` stays in its folder."""
    quoted = F.regexp_replace(pattern, r"([\\.^$+{}()|])", r"\\$1")
    marked = F.replace(F.replace(quoted, F.lit("**/"), F.lit("\u0001")), F.lit("**"), F.lit("\u0002"))
    flat = F.replace(F.replace(marked, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    return F.regexp_like(path, F.concat(F.lit("^"), F.replace(F.replace(flat, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*")), F.lit("$")))


def _quoted(x: Column) -> Column:
    return F.regexp_replace(x, r"([^\w\s])", r"\\$1")


def verify(intents: DataFrame, files: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """``(intent_id, place, description, check_type, passed, reason)``, a row a criterion.

    A criterion with a value that can't be read, one of kind ``manual``, and one that runs something but has no result
    fail. The criteria are a checked, bounded table that is broadcast to the files: a file is read once for all.
    """
    c = criteria(intents)
    if c.limit(CRITERIA + 1).count() > CRITERIA:
        raise ValueError(f"more than {CRITERIA} criteria")
    value = F.coalesce("check_value", F.lit(""))
    at, what = _two(value, "::")
    left, right = _two(value, "->")
    c = c.withColumns({"a": F.when(F.col("check_type") == "wired", left).otherwise(at), "b": F.when(F.col("check_type") == "wired", right).otherwise(what), "v": F.trim(value)})
    kind, path, text = F.col("check_type"), F.col("file_path"), F.coalesce("content", F.lit(""))
    plain = ~path.rlike(SKIPPED)
    hit = (
        F.when(kind == "file_exists", (path == F.col("v")) | path.startswith(F.concat("v", F.lit("/"))))
        .when(kind == "file_contains", (path == F.col("a")) & F.regexp_like(text, F.coalesce("b", F.lit(r"\b\B"))))
        .when(kind == "function_exists", plain & path.endswith(".py") & F.regexp_like(text, F.concat(F.lit(r"(def|class|function|async def)\s+"), _quoted(F.col("v")), F.lit(r"\b"))))
        .when(kind == "wired", plain & path.endswith(".py") & F.contains(path, F.col("a")) & F.contains(text, F.col("b")))
        .when(kind == "mcp_tool_exists", path.rlike(r"(^|/)mcp/server\.py$") & (F.contains(text, F.concat(F.lit('name="'), "v", F.lit('"'))) | F.contains(text, F.concat(F.lit("name='"), "v", F.lit("'")))))
        .when(kind.isin("grep_match", "grep_no_match"), plain & as_glob(path, F.coalesce("b", F.lit(DEFAULT_GLOB))) & F.regexp_like(text, F.col("a")))
    )
    asked = F.broadcast(c.select("intent_id", "place", "check_type", "a", "b", "v"))
    found = files.join(asked, F.coalesce(hit, F.lit(False))).groupBy("intent_id", "place").agg(F.min("file_path").alias("found"))
    got = c.join(found, ["intent_id", "place"], "left")
    got = got.join(results.select("intent_id", "place", F.col("passed").alias("ran")), ["intent_id", "place"], "left") if results is not None else got.withColumn("ran", F.lit(None).cast("boolean"))
    malformed = kind.isin("file_contains", "wired") & F.col("b").isNull()
    there = F.col("found").isNotNull()
    passed = F.when(malformed, False).when(kind == "grep_no_match", ~there).when(kind.isin(*READ_KINDS), there).when(kind.isin(*RUN_KINDS), F.coalesce("ran", F.lit(False))).otherwise(False)
    reason = (
        F.when(F.col("passed"), F.lit(None))
        .when(malformed, "its value can't be read")
        .when(kind == "grep_no_match", F.concat(F.lit("still found in "), "found"))
        .when(kind.isin(*RUN_KINDS), "did not succeed")
        .when(kind == "manual", "needs a person")
        .otherwise(F.concat(F.lit("not found: "), value))
    )
    return got.withColumn("passed", passed).select("intent_id", "place", "description", "check_type", "passed", reason.alias("reason"))


def rollup(intents: DataFrame, checked: DataFrame) -> DataFrame:
    """``(intent_id, total, passed, failed, status, completion_pct, gaps)``; ``gaps`` are the failed criteria in order."""
    n = checked.groupBy("intent_id").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("place", "description", "reason")))).alias("gaps"))
    got = intents.select(F.col("id").alias("intent_id")).join(n, "intent_id", "left").fillna(0, ["total", "passed"])
    status = F.when(F.col("total") == 0, "active").when(F.col("passed") == F.col("total"), "verified").when(F.col("passed") > 0, "partial").otherwise("failed")
    pct = F.when(F.col("total") > 0, F.round(100.0 * F.col("passed") / F.col("total"), 1)).otherwise(F.lit(0.0))
    none = F.expr("cast(array() as array<struct<place:int,description:string,reason:string>>)")
    return got.select("intent_id", "total", "passed", (F.col("total") - F.col("passed")).alias("failed"), status.alias("status"), pct.alias("completion_pct"), F.coalesce("gaps", none).alias("gaps"))


def with_results(intents: DataFrame, checked: DataFrame) -> DataFrame:
    """Intents with each criterion's ``satisfied`` and the rolled-up ``status``, as they are saved after a check."""
    ok = checked.groupBy("intent_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "passed"))).alias("ok"))
    got = intents.join(ok.withColumnRenamed("intent_id", "id"), "id", "left").join(rollup(intents, checked).select(F.col("intent_id").alias("id"), F.col("status").alias("now")), "id")
    each = F.transform("criteria", lambda c, i: c.withField("satisfied", F.coalesce(F.element_at("ok", i), F.lit(False))))
    return got.withColumns({"criteria": each, "status": F.col("now")}).select(*intents.columns)


def open_intents(intents: DataFrame, status: str | None = None) -> DataFrame:
    """Intents of a status; without one those that are still worked on."""
    return intents.filter(F.col("status") == status) if status else intents.filter(F.col("status").isin("active", "partial", "failed"))

