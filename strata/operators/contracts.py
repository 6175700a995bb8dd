"""Contracts over files: scopes, rules, violations and their rollup.

Frames: ``contracts(id, priority, scope, rules)`` as ``sources.records.read_contracts`` gives them;
``files(file_path, content)``; ``nodes(file_path, kind, name, line_start, line_end)``. Rules are few (a bounded
table that is broadcast), files and their lines are read once for all rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import paths
from strata.functions.glob import matches_any

#: most rules that are broadcast beside the lines; a larger table is joined as the session sees fit
RULES = 10_000
RULE = "contract_id string, priority int, rule_id string, name string, description string, kind string, severity string, pattern string, anti_pattern string, threshold_metric string, threshold_value double, fix_suggestion string, migration_deadline timestamp"
#: fixed values: kinds whose rules are line patterns
LINE_KINDS = ("pattern", "architectural", "ai_antipattern")


def by_priority(contracts: DataFrame) -> DataFrame:
    """``contracts`` with ``place``, highest priority first, then as they came by id."""
    from pyspark.sql import Window

    return contracts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "id")))


def described(files: DataFrame) -> DataFrame:
    """``files(file_path, content)`` with ``language``, ``is_test`` and ``is_generated`` as scopes ask for them."""
    path = F.col("file_path")
    return files.withColumns({"language": paths.language(path), "is_test": paths.is_test_for_rules(path), "is_generated": paths.is_generated(F.col("content"))})


def in_scope(scope: Column, path: Column, language: Column, is_test: Column, is_generated: Column) -> Column:
    """Whether a file is in a contract's scope: no excluded test or generated file, a language asked for, no exclude glob, an include glob if there are any."""
    none = F.array().cast("array<string>")
    languages, inside, outside = (F.coalesce(scope[c], none) for c in ("languages", "include_patterns", "exclude_patterns"))
    return (
        ~(F.coalesce(scope["exclude_tests"], F.lit(False)) & is_test)
        & ~(F.coalesce(scope["exclude_generated"], F.lit(True)) & is_generated)
        & ((F.size(languages) == 0) | F.array_contains(languages, language))
        & ~matches_any(path, outside)
        & ((F.size(inside) == 0) | matches_any(path, inside))
    )


def applicable(files: DataFrame, contracts: DataFrame) -> DataFrame:
    """``(file_path, contract_id, priority)`` of every file and each contract whose scope holds it (nulls in a scope ask for nothing)."""
    f = described(files).select("file_path", "language", "is_test", "is_generated").distinct()
    c = contracts.select(F.col("id").alias("contract_id"), "priority", "scope")
    ok = in_scope(F.col("scope"), F.col("file_path"), F.col("language"), F.col("is_test"), F.col("is_generated"))
    return f.join(F.broadcast(_few(c)), ok).select("file_path", "contract_id", "priority")


def guidance(files: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contracts that apply to any of ``files``, highest priority first: ``(contract_id, priority, place)``."""
    got = applicable(files, contracts).groupBy("contract_id").agg(F.first("priority").alias("priority"))
    return by_priority(got.withColumnRenamed("contract_id", "id")).withColumnRenamed("id", "contract_id")


def rules(contracts: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """``RULE``: a row a rule, of the contracts with these ids (all, if none is named)."""
    c = contracts.filter(F.col("id").isin(*only)) if only else contracts
    r = c.select(F.col("id").alias("contract_id"), "priority", F.explode("rules").alias("r"))
    fields = {f.name for f in contracts.schema["rules"].dataType.elementType.fields}
    own = [(F.col("r.id") if x == "rule_id" else F.col(f"r.{x}") if x in fields else F.lit(None)).cast(t).alias(x) for x, t in (y.split() for y in RULE.split(", ")[2:])]
    return r.select("contract_id", "priority", *own)


def effective_severity(severity: Column, deadline: Column, as_of: Column, strict: bool = False) -> Column:
    """``error`` once the migration's deadline has passed; in strict mode a warning is one too."""
    now = F.when(deadline.isNotNull() & (as_of > deadline), "error").otherwise(severity)
    return F.when(now == "warning", "error").otherwise(now) if strict else now


def valid(pattern: str) -> bool:
    """Whether the JVM takes the pattern."""
    from pyspark.errors import IllegalArgumentException
    from pyspark.sql import SparkSession

    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:  # what a syntax error of a pattern is
        return False
    return True


def violations(files: DataFrame, contracts: DataFrame, nodes: DataFrame | None = None, as_of: str = "now", strict: bool = False) -> DataFrame:
    """``(file_path, contract_id, rule_id, severity, line, message, matched)``: what the rules of contracts in whose scope a file is find in it.

    Line patterns look at one line at a time and skip comment lines; a required pattern is looked for in the whole
    file (multi-line mode); ``max_lines`` counts line ends and one; ``max_function_lines`` asks ``nodes``. Rules whose regex
    doesn't compile, and kinds without a check, find nothing. A file with null content is an error row of its own.
    """
    now = F.current_timestamp() if as_of == "now" else F.lit(as_of).cast("timestamp")
    every = rules(contracts).withColumn("severity", effective_severity(F.col("severity"), F.col("migration_deadline"), now, strict))
    table = every.limit(RULES + 1).collect()  # of bounded size: rules are written by hand
    if len(table) > RULES:
        raise ValueError(f"more than {RULES} rules")
    # scopes as literals, so that a file and each of its lines is read once for all contracts
    f = described(files.select("file_path", "content"))
    held = [F.when(in_scope(_literal(c.scope), F.col("file_path"), F.col("language"), F.col("is_test"), F.col("is_generated")), F.lit(c.id)) for c in _few(contracts.select("id", "scope")).collect()]
    own = f.select("file_path", "content", F.array_compact(F.array(*held)).alias("held") if held else F.array().cast("array<string>").alias("held")).filter(F.size("held") > 0)
    text = F.coalesce("content", F.lit(""))
    lined, whole = [], []
    for r in table:
        made = [F.lit(r[c]).alias(c) for c in ("contract_id", "rule_id", "severity")]
        applies = F.array_contains("held", r.contract_id)
        if r.pattern and r.kind in LINE_KINDS and valid(r.pattern):
            lined.append(F.when(applies & F.col("t").rlike(r.pattern), F.struct(*made, F.lit(r.description).alias("message"), F.regexp_extract("t", r.pattern, 0).alias("matched"))))
        if r.anti_pattern and r.kind in LINE_KINDS and valid(r.anti_pattern):
            whole.append(F.when(applies & ~text.rlike(f"(?m){r.anti_pattern}"), F.struct(*made, F.lit(f"Required pattern is missing: {r.anti_pattern}").alias("message"))))
        if r.kind == "threshold" and r.threshold_metric == "max_lines" and r.threshold_value is not None:
            n = F.size(F.split(text, "\n", -1))
            whole.append(F.when(applies & (n > r.threshold_value), F.struct(*made, F.concat(F.lit("File has "), n.cast("string"), F.lit(f" lines (max: {int(r.threshold_value)})")).alias("message"))))
    columns = ["file_path", "contract_id", "rule_id", "severity", "line", "message", "matched"]
    none = F.lit(None)
    out = files.filter("content is null").select("file_path", none.cast("string").alias("contract_id"), F.lit("unreadable").alias("rule_id"), F.lit("error").alias("severity"), none.cast("int").alias("line"), F.lit("File can't be read").alias("message"), none.cast("string").alias("matched"))
    if lined:
        rows = own.select("file_path", "held", F.posexplode(F.split(text, "\n", -1)).alias("i", "t")).filter(~is_comment(F.col("t")))
        rows = rows.select("file_path", (F.col("i") + 1).alias("line"), F.explode(F.filter(F.array(*lined), lambda v: v.isNotNull())).alias("v"))
        out = out.unionByName(rows.select("file_path", "line", "v.*").select(*columns))
    if whole:
        rows = own.select("file_path", F.explode(F.filter(F.array(*whole), lambda v: v.isNotNull())).alias("v"))
        out = out.unionByName(rows.select("file_path", "v.*", none.cast("int").alias("line"), none.cast("string").alias("matched")).select(*columns))
    if nodes is not None:
        limits = every.filter("kind = 'threshold' and threshold_metric = 'max_function_lines' and threshold_value is not null")
        n = nodes.filter(F.col("kind").isin("function", "method") & F.col("line_start").isNotNull()).withColumn("span", F.col("line_end") - F.col("line_start") + 1).select("file_path", "name", "line_start", "span")
        rows = n.join(own.select("file_path", F.explode("held").alias("contract_id")), "file_path").join(F.broadcast(limits.select("contract_id", "rule_id", "severity", "threshold_value")), "contract_id").filter(F.col("span") > F.col("threshold_value"))
        said = F.concat(F.lit("Function '"), "name", F.lit("' has "), F.col("span").cast("string"), F.lit(" lines (max: "), F.col("threshold_value").cast("int").cast("string"), F.lit(")"))
        out = out.unionByName(rows.select("file_path", "contract_id", "rule_id", "severity", F.col("line_start").cast("int").alias("line"), said.alias("message"), none.cast("string").alias("matched")))
    return out


def rollup(found: DataFrame) -> DataFrame:
    """Violations -> ``(file_path, errors, warnings, blocking)``."""
    n = [F.count_if(F.col("severity") == s).alias(c) for s, c in (("error", "errors"), ("warning", "warnings"))]
    return found.groupBy("file_path").agg(*n).withColumn("blocking", F.col("errors") > 0)


def conflicts(contracts: DataFrame) -> DataFrame:
    """``(metric, details)`` of metrics for which contracts set more than one threshold; details by priority, highest first."""
    r = rules(contracts).filter("threshold_metric is not null and threshold_value is not null")
    row = F.struct((-F.col("priority")).alias("p"), "contract_id", "threshold_value")
    said = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.concat(x["contract_id"], F.lit(":"), _number(x["threshold_value"])))
    return r.groupBy(F.col("threshold_metric").alias("metric")).agg(F.count_distinct("threshold_value").alias("n"), F.array_join(said, ",").alias("details")).filter("n > 1").drop("n")


def is_comment(line: Column) -> Column:
    return F.trim(line).rlike(r"^(#|//|/\*|\*)")


def merged(builtin: DataFrame, project: DataFrame) -> DataFrame:
    """Builtin contracts without those whose id a project has too, and the project's; of one id the last file wins."""
    from pyspark.sql import Window

    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("file_path")))
    own = project.withColumn("_n", last).filter("_n = 1").drop("_n")
    return builtin.join(own.select("id"), "id", "left_anti").unionByName(own, allowMissingColumns=True)


def _literal(scope) -> Column:
    """A scope as a constant; null is the empty scope."""
    s = scope.asDict() if scope else {}
    lists = [F.array(*[F.lit(x) for x in s.get(c) or []]).cast("array<string>").alias(c) for c in ("languages", "include_patterns", "exclude_patterns")]
    return F.struct(*lists, *[F.lit(s.get(c)).cast("boolean").alias(c) for c in ("exclude_tests", "exclude_generated")])


def _few(table: DataFrame) -> DataFrame:
    """A table that must be small: fails rather than broadcast more than ``RULES`` rows."""
    if table.limit(RULES + 1).count() > RULES:
        raise ValueError(f"more than {RULES} contracts")
    return table


def _number(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def draft(conventions: DataFrame, contract_id: str = "auto-detected") -> DataFrame:
    """One contract of the rules that ``operators.conventions`` suggests, for source files other than tests and generated ones."""
    scope = F.struct(F.array().cast("array<string>").alias("include_patterns"), F.array().cast("array<string>").alias("exclude_patterns"), F.array().cast("array<string>").alias("languages"), F.lit(True).alias("exclude_tests"), F.lit(True).alias("exclude_generated"))
    found = conventions.filter("rule is not null").agg(F.array_sort(F.collect_list("rule")).alias("rules"), F.count("*").alias("n"))
    return found.select(F.lit(contract_id).alias("id"), F.lit("Conventions found in this project").alias("name"), F.concat(F.lit("Made from "), F.col("n").cast("string"), F.lit(" conventions; read before use.")).alias("description"), F.lit(150).alias("priority"), scope.alias("scope"), "rules")

