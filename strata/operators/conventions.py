"""Conventions that a project's files follow, with a rule for each that a contract may take.

Detectors read ``files(file_path, content)`` and give ``(name, kind, confidence, occurrences, violations, examples,
counter_examples, rule)``: no row where there is too little to go by. A detector is one pass of flags and one global
aggregate; examples are the first paths in order, kept by bounded aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import paths

RULE = "struct<id:string,name:string,description:string,kind:string,severity:string,pattern:string,anti_pattern:string,threshold_metric:string,threshold_value:double,fix_suggestion:string,migration_deadline:timestamp>"
SCHEMA = f"name string, kind string, confidence double, occurrences long, violations long, examples array<string>, counter_examples array<string>, rule {RULE}"
#: fixed values: what a file of request handlers holds
HANDLER_MARKS = ("@router.", "@app.", "async def get", "async def post", "async def create")
#: fixed values: parts of paths of routing files, and modules that they shouldn't import
ROUTE_MARKS = ("route", "router", "api", "endpoint", "view")
STORE_IMPORT = r"from\s+\w*(models?|db|database|orm|tortoise|sqlalchemy)\w*\s+import"
#: fixed values: folders of tests
TEST_FOLDERS = ("tests", "test", "__tests__")


def _rule(id_: str, name: str, said: str, kind: str, severity: str, pattern: str | None, fix: str) -> Column:
    values = {"id": id_, "name": name, "description": said, "kind": kind, "severity": severity, "pattern": pattern, "fix_suggestion": fix}
    fields = [f.split(":") for f in RULE[7:-1].split(",")]
    return F.struct(*[F.lit(values.get(n)).cast(t).alias(n) for n, t in fields])


def _two_sided(rows: DataFrame, name: str, kind: str, rule: Column, enough: Column) -> DataFrame:
    """``rows(file_path, good, bad)`` -> one row if ``enough`` of (good, bad) holds."""
    shown = rows.filter("good or bad")
    counts = shown.agg(F.count_if("good").alias("occurrences"), F.count_if("bad").alias("violations"))
    firsts = [shown.filter(c).orderBy("file_path").limit(3).agg(F.array_sort(F.collect_list("file_path")).alias(a)) for c, a in (("good", "examples"), ("bad", "counter_examples"))]
    got = counts.filter(enough).crossJoin(firsts[0]).crossJoin(firsts[1])  # three tables of one row
    sure = F.col("occurrences") / F.greatest(F.col("occurrences") + F.col("violations"), F.lit(1))
    return got.select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), sure.alias("confidence"), "occurrences", "violations", "examples", "counter_examples", rule.alias("rule"))


def _majority(least: int = 3) -> Column:
    return (F.col("occurrences") + F.col("violations") >= least) & (F.col("occurrences") > F.col("violations"))


def _python(files: DataFrame) -> DataFrame:
    return files.filter(F.col("file_path").endswith(".py")).withColumn("content", F.coalesce("content", F.lit("")))


def async_handlers(files: DataFrame) -> DataFrame:
    """Handler files with an ``async def`` against those with plain ones only; three and more, and a majority."""
    text = F.col("content")
    f = _python(files).filter(reduce(lambda a, b: a | b, [text.contains(m) for m in HANDLER_MARKS]))
    is_async, is_sync = text.rlike(r"async\s+def\s+\w+"), text.rlike(r"(?<!async\s)def\s+\w+")
    rule = _rule("auto-async-handlers", "Handlers are async", "Most handler files of this project use async functions.", "pattern", "warning", r"(?<!async\s)def\s+(get_|post_|put_|delete_|patch_|create_|update_|list_)", "Write handlers as `async def`.")
    return _two_sided(f.select("file_path", is_async.alias("good"), (is_sync & ~is_async).alias("bad")), "Async handlers", "pattern", rule, _majority())


def layers(files: DataFrame) -> DataFrame:
    """Routing files that keep from importing the store; three and more, and a majority."""
    low = F.lower("file_path")
    f = files.filter(reduce(lambda a, b: a | b, [low.contains(m) for m in ROUTE_MARKS])).withColumn("bad", F.coalesce(F.col("content").rlike(STORE_IMPORT), F.lit(False)))
    rule = _rule("auto-no-db-in-routes", "Routes don't import the store", "Routing files leave the database to a service layer.", "architectural", "warning", r"from\s+\w*(models?|db|database)\w*\s+import", "Import a service in place of the model.")
    return _two_sided(f.select("file_path", (~F.col("bad")).alias("good"), "bad"), "Layer separation", "architectural", rule, _majority())


def service_names(files: DataFrame) -> DataFrame:
    """Three and more distinct classes that are named as services."""
    found = files.select(F.explode(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"class\s+(\w+Service)\b"), F.lit(1))).alias("name")).distinct()
    rule = _rule("auto-service-naming", "Services are named so", "Service classes of this project end in Service.", "pattern", "info", None, "End the class's name in Service.")
    got = found.agg(F.count("*").alias("n")).crossJoin(found.orderBy("name").limit(5).agg(F.array_sort(F.collect_list("name")).alias("examples"))).filter("n >= 3")  # two tables of one row
    return got.select(F.lit("Service class naming").alias("name"), F.lit("pattern").alias("kind"), F.lit(0.9).alias("confidence"), F.col("n").alias("occurrences"), F.lit(0).cast("long").alias("violations"), "examples", F.array().cast("array<string>").alias("counter_examples"), rule.alias("rule"))


def own_exceptions(files: DataFrame) -> DataFrame:
    """Files that raise named errors against those with a bare except; three and more of the first."""
    text = F.col("content")
    rule = _rule("auto-no-bare-except", "No bare except", "This project raises errors of its own; a bare except hides them.", "pattern", "warning", r"except\s*:", "Name what is caught.")
    f = _python(files).select("file_path", text.rlike(r"raise\s+\w+(Error|Exception)\(").alias("good"), text.rlike(r"except\s*:").alias("bad"))
    return _two_sided(f, "Custom exceptions", "pattern", rule, F.col("occurrences") >= 3)


def mirrored_tests(files: DataFrame) -> DataFrame:
    """Source modules that a test file is named for; from 30 in a hundred."""
    path, stem = F.col("file_path"), paths.stem(F.col("file_path"))
    in_tests = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in TEST_FOLDERS]))
    tests = files.filter(in_tests).select(F.replace(F.replace(stem, F.lit("test_")), F.lit("_test")).alias("stem")).distinct()
    sources = files.filter(~in_tests & path.endswith(".py") & ~stem.startswith("_")).select(stem.alias("stem")).distinct()
    both = sources.join(tests.withColumn("hit", F.lit(True)), "stem", "left")
    got = both.agg(F.count("*").alias("n"), F.count("hit").alias("occurrences"))
    firsts = both.filter("hit").orderBy("stem").limit(5).agg(F.array_sort(F.collect_list("stem")).alias("examples"))
    rule = _rule("auto-test-coverage", "Modules have a test file", "Modules of this project have test files of their name.", "architectural", "info", None, "Add test_<module>.py.")
    got = got.filter("n > 0 and occurrences / n >= 0.3").crossJoin(firsts)  # two tables of one row
    return got.select(F.lit("Test coverage structure").alias("name"), F.lit("architectural").alias("kind"), (F.col("occurrences") / F.col("n")).alias("confidence"), "occurrences", (F.col("n") - F.col("occurrences")).alias("violations"), "examples", F.array().cast("array<string>").alias("counter_examples"), rule.alias("rule"))


def docstrings(files: DataFrame) -> DataFrame:
    """Public functions with a docstring, of ten and more; from 60 in a hundred."""
    pattern = r'(?s)def\s+([a-z]\w+)\s*\(.*?\).*?:\s*\n(\s+""")?'
    each = _python(files).select(F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(2))).alias("doc"))
    got = each.agg(F.count_if(F.col("doc") != "").alias("occurrences"), F.count_if(F.col("doc") == "").alias("violations"))
    n = F.col("occurrences") + F.col("violations")
    rule = _rule("auto-docstrings", "Public functions have docstrings", "Most public functions of this project have one.", "pattern", "info", None, "Say in a line what the function does.")
    none = F.array().cast("array<string>")
    got = got.filter((n >= 10) & (F.col("occurrences") / F.greatest(n, F.lit(1)) >= 0.6))
    return got.select(F.lit("Docstring convention").alias("name"), F.lit("pattern").alias("kind"), (F.col("occurrences") / n).alias("confidence"), "occurrences", "violations", none.alias("examples"), none.alias("counter_examples"), rule.alias("rule"))


def analyze(files: DataFrame, least: float = 0.7) -> DataFrame:
    """All detectors' rows of confidence ``least`` and more. No files: no rows."""
    every = [d(files) for d in (async_handlers, layers, service_names, own_exceptions, mirrored_tests, docstrings)]
    return reduce(DataFrame.unionByName, every).filter(F.col("confidence") >= least)
