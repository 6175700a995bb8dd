"""Assembling the context of a request: what the graph, decisions and contracts offer, ranked and packed into a budget.

``requests(request, file_path)``: the files that each request asks for. Items are
``(request, ordinal, source, item_type, priority, freshness, tokens, content, ref)``; all requests are served by one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import paths
from strata.operators import budget, contracts, decisions, graph

ITEM = ("request", "ordinal", "source", "item_type", "priority", "freshness", "tokens", "content", "ref")
#: lines of a file that a critical item and any other shows
MOST_CRITICAL, MOST = 1000, 200
#: decisions that a request is offered
DECISIONS = 5
MARKER = "\n[... cut to fit the budget ...]"
ORDER = ("critical", "high", "medium", "low")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def file_text(path: Column, content: Column, critical: Column) -> Column:
    """A file as an item shows it: its name, then its text, or its first lines and how many there are."""
    lines = F.split(content, "\n", -1)
    most = F.when(critical, MOST_CRITICAL).otherwise(MOST)
    short = F.concat(F.lit("# File: "), name_of(path), F.lit(" ("), F.size(lines).cast("string"), F.lit(" lines, first "), most.cast("string"), F.lit(")\n"), F.array_join(F.slice(lines, F.lit(1), most), "\n"), F.lit("\n[... cut ...]"))
    return F.when(F.size(lines) > most, short).otherwise(F.concat(F.lit("# File: "), name_of(path), F.lit("\n"), content))


def node_text(nodes: DataFrame) -> Column:
    """A node in a line or three: kind and name, docstring, place."""
    doc = F.substring("docstring", 1, 200) if "docstring" in nodes.columns else F.lit(None).cast("string")
    place = F.when(F.col("line_start").isNotNull(), F.concat(F.lit("  "), name_of(F.col("file_path")), F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")))
    return F.concat_ws("\n", F.concat_ws(": ", "kind", "qualified_name"), F.concat(F.lit("  "), doc), place)


def graph_items(requests: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame, depth: int = 2) -> DataFrame:
    """An item a node that matters to a request: files' texts for critical and high ones, summaries for the rest, a warning for each unknown file.

    Own nodes are critical, what their modules reach within two edges high, further medium, tests of the same name low;
    external nodes are left out and the first of these wins. A file that isn't there gives no item.
    """
    asked = requests.select("request", "file_path").distinct()
    inner = nodes.filter("not is_external") if "is_external" in nodes.columns else nodes
    own = asked.join(inner, "file_path")
    starts = own.filter("kind = 'module'").select("request", F.col("node_id").alias("start"))
    far = graph.reach(starts.select("start", F.col("start").alias("node_id")).distinct(), edges, depth + 1, forward=True, type_only=True)
    far = starts.join(far, "start").groupBy("request", "node_id").agg(F.min("hop").alias("hop"))
    tests = graph.tests_of(own.select("request", "node_id", "kind", "name"), nodes, edges).withColumnRenamed("test_id", "node_id")
    every = (
        own.select("request", "node_id", F.lit(0).alias("rank"))
        .unionByName(far.select("request", "node_id", F.when(F.col("hop") <= depth, 1).otherwise(2).alias("rank")))
        .unionByName(tests.select("request", "node_id", F.lit(3).alias("rank")))
    )
    got = every.groupBy("request", "node_id").agg(F.min("rank").alias("rank")).join(inner.withColumn("summary", node_text(inner)).select("node_id", "file_path", "summary"), "node_id")
    text = files.select("file_path", "content").dropDuplicates(["file_path"])
    got = got.join(text, "file_path", "left").withColumn("content", F.when(F.col("rank") < 2, file_text(F.col("file_path"), F.col("content"), F.col("rank") == 0)).otherwise(F.col("summary"))).filter("content is not null")
    items = _items(got, F.concat(F.lit("n:"), F.col("node_id").cast("string")), "graph", "file_content", graph.priority(F.col("rank")), F.lit(1.0), F.col("content"), F.col("file_path"))
    lost = asked.join(nodes.select("file_path").distinct(), "file_path", "left_anti")
    said = F.concat(F.lit("No node of the graph is in "), "file_path")
    return items.unionByName(_items(lost, F.concat(F.lit("w:"), "file_path"), "graph", "warning", F.lit("high"), F.lit(1.0), said, F.col("file_path")))


def freshness(review_by: Column, last_validated: Column, as_of: Column, days: float = 90.0) -> Column:
    """0.3 past the review date; else falling with the days since the last validation, to 0.2; never validated: 1."""
    since = F.floor((as_of.cast("double") - last_validated.cast("timestamp").cast("double")) / 86400)
    return F.when(decisions.is_stale(review_by, as_of), 0.3).when(last_validated.isNotNull(), F.greatest(F.lit(0.2), 1 - since / days)).otherwise(F.lit(1.0)).cast("double")


def decision_items(requests: DataFrame, journal: DataFrame, as_of: Column, days: float = 90.0, most: int = DECISIONS) -> DataFrame:
    """Of each request the ``most`` decisions that matter most: from 0.8 high, from 0.3 medium, else low; with a hard constraint high at least."""
    from pyspark.sql import Window

    live = journal.filter(decisions.is_open(F.col("status")))
    rungs = lambda d, p: d.select("*", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), k.alias("key")) for s, k in ((1.0, p), (0.5, decisions.folder(p)), (0.2, decisions.head(p)))])).alias("k")).select("*", "k.*").drop("k")
    a = rungs(decisions.anchors(live).select("id", "file_path").distinct(), F.col("file_path")).select("id", "score", "key")
    want = rungs(requests.select("request", "file_path").distinct(), F.col("file_path")).select("request", "score", "key").distinct()
    hit = want.join(a, ["score", "key"]).groupBy("request", "id").agg(F.max("score").alias("score"))
    # decisions that are anchored nowhere are offered to all: no more of them than a request may take
    bare = live.filter(F.coalesce(F.size("code_anchors"), F.lit(0)) <= 0).orderBy("id").limit(most).select("id", F.lit(0.1).alias("score"))
    hit = hit.unionByName(requests.select("request").distinct().join(F.broadcast(bare)).select("request", "id", "score"))
    top = hit.withColumn("_n", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "id"))).filter(F.col("_n") <= most).drop("_n")
    got = top.join(live, "id")
    hard = F.coalesce(F.exists("constraints", lambda c: F.coalesce(c["is_hard"], F.lit(False))), F.lit(False))
    priority = F.when((F.col("score") >= 0.8) | hard, "high").when(F.col("score") >= 0.3, "medium").otherwise("low")
    validated = F.col("last_validated") if "last_validated" in journal.columns else F.lit(None).cast("timestamp")
    got = got.withColumns({"_p": priority, "_f": freshness(F.col("review_by"), validated, as_of, days)})
    return _items(got, F.concat(F.lit("d:"), "id"), "decisions", "decision", F.col("_p"), F.col("_f"), decision_text(as_of, F.col("_p") == "high"), F.col("id"))


def decision_text(as_of: Column, verbose: Column) -> Column:
    """A decision as text; short without its context and constraints."""
    stale = decisions.is_stale(F.col("review_by"), as_of)
    hard = F.transform("constraints", lambda c: F.concat(F.lit("- ["), F.when(c["is_hard"], "MUST").otherwise("SHOULD"), F.lit("] "), c["description"], F.lit(" (source: "), F.coalesce(c["source"], F.lit("unknown")), F.lit(")")))
    return F.concat_ws(
        "\n", F.concat(F.lit("## Decision: "), F.coalesce("title", F.lit("")), F.lit(" ["), "id", F.lit("]")), F.concat(F.lit("Status: "), "status"), F.when(verbose, F.concat(F.lit("**Context:** "), F.coalesce("context", F.lit("")))),
        F.concat(F.lit("**Decision:** "), F.coalesce("decision", F.lit(""))), F.when(verbose & (F.size("constraints") > 0), F.concat(F.lit("**Constraints:**\n"), F.array_join(hard, "\n"))), F.when(stale, F.concat(F.lit("**Review was due on "), F.date_format("review_by", "yyyy-MM-dd"), F.lit("**"))),
    )


def contract_items(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Every contract in whose scope one of a request's files is, once, as a medium item."""
    files = requests.select("file_path").distinct().withColumn("content", F.lit(""))
    own = requests.select("request", "file_path").join(contracts.applicable(files, held).select("file_path", F.col("contract_id").alias("id")), "file_path").select("request", "id").distinct()
    each = F.transform("rules", lambda r: F.concat(F.lit("- ["), F.upper(r["severity"]), F.lit("] **"), r["name"], F.lit("**: "), F.coalesce(r["description"], F.lit(""))))
    text = F.concat_ws("\n", F.concat(F.lit("## Contract: "), "name", F.lit(" ["), "id", F.lit("]")), F.concat(F.lit("Priority: "), F.col("priority").cast("string")), F.array_join(each, "\n"))
    return _items(own.join(held, "id"), F.concat(F.lit("c:"), "id"), "contracts", "contract_rule", F.lit("medium"), F.lit(1.0), text, F.col("id"))


def _items(rows: DataFrame, ordinal: Column, source: str, kind: str, priority: Column, fresh: Column, content: Column, ref: Column) -> DataFrame:
    got = rows.select("request", ordinal.alias("ordinal"), F.lit(source).alias("source"), F.lit(kind).alias("item_type"), priority.alias("priority"), fresh.cast("double").alias("freshness"), content.alias("content"), ref.cast("string").alias("ref"))
    return got.withColumn("tokens", budget.tokens(F.col("content"))).select(*ITEM)


def assemble(items: DataFrame, total: int) -> DataFrame:
    """Items with ``taken``, and with the text and tokens they end with.

    In order of priority, freshness, size and ordinal each item is taken that still fits. A critical item that doesn't fit
    while nothing is taken yet is cut to the budget. Without a budget nothing is taken.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("priority")) - 1
    ranked = items.withColumn("rank", F.when(rank < 0, 3).otherwise(rank).cast("int"))
    chosen = budget.choose(ranked, total).select("request", "ordinal", "taken", "cut")
    got = ranked.join(chosen, ["request", "ordinal"])
    short = cut_text(F.col("content"), F.col("ref"), total)
    got = got.withColumn("content", F.when(F.col("cut"), short).otherwise(F.col("content")))
    return got.withColumn("tokens", F.when(F.col("cut"), budget.tokens(F.col("content"))).otherwise(F.col("tokens"))).drop("rank")


def cut_text(content: Column, ref: Column, total: int) -> Column:
    """The first lines of a text that fit a budget with a marker; if none does, a line that names it."""
    room = total - -(-len(MARKER) // 4)
    lines = F.split(content, "\n", -1)
    # lines that fit are a prefix, so their number is found by a fold that stops counting
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("on"))

    def step(acc: Column, line: Column) -> Column:
        used = acc["used"] + F.ceil((F.length(line) + 1) / 4).cast("long")
        fits = acc["on"] & (used <= room)
        return F.struct(F.when(fits, used).otherwise(acc["used"]).alias("used"), (acc["kept"] + F.when(fits, 1).otherwise(0)).alias("kept"), fits.alias("on"))

    kept = F.aggregate(lines, start, step, lambda a: a["kept"])
    return F.when(kept > 0, F.concat(F.array_join(F.slice(lines, F.lit(1), kept), "\n"), F.lit(MARKER))).otherwise(F.concat(F.lit("[File: "), F.coalesce(ref, F.lit("unknown")), F.lit(", cut]")))


def contradictions(assembled: DataFrame, anchored: DataFrame) -> DataFrame:
    """Stale decisions that are taken beside contracts: ``(request, decision_id, contract_id, text)``.

    A pair needs a decision with a known file: ``anchored(id)``. A request holds few of either, so pairs are made within it.
    """
    t = assembled.filter("taken")
    d = t.filter("item_type = 'decision' and freshness < 0.5").select("request", F.col("ref").alias("decision_id")).join(anchored.select(F.col("id").alias("decision_id")).distinct(), "decision_id")
    c = t.filter("item_type = 'contract_rule'").select("request", F.col("ref").alias("contract_id"))
    said = F.concat(F.lit("Decision "), "decision_id", F.lit(" is past its review and contract '"), "contract_id", F.lit("' applies as well: see whether the decision still holds."))
    return d.join(c, "request").select("request", "decision_id", "contract_id", said.alias("text"))


def naive_tokens(requests: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = (".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".java")) -> DataFrame:
    """``(request, tokens)``: what reading the asked files and all code beside them would cost, a file once."""
    code = files.filter(paths.suffix(F.col("file_path")).isin(*suffixes)).select("file_path", decisions.folder(F.col("file_path")).alias("folder"), budget.tokens(F.col("content")).alias("tokens"))
    want = requests.select("request", decisions.folder(F.col("file_path")).alias("folder")).distinct()
    got = want.join(code, "folder").groupBy("request").agg(F.sum("tokens").alias("tokens"))
    return requests.select("request").distinct().join(got, "request", "left").fillna(0)
