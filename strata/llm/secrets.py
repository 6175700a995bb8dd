"""Secret scans over a trigram inverted index, with DataFrame functions only.

Every rule's regex is turned into a Boolean query over trigrams that each of its matches must contain.
The index holds a posting for each trigram that a rule asks for and each block of 32,768 rows: a bitmap
of the rows that have it, aggregated where the rows are. Postings are intersected a conjunction,
united a rule, and the rows that remain are joined back to their texts by content hash and verified
with the rule's regex. A rule without mandatory trigrams scans every text when the index is made.

Texts are joined by a 128-bit hash of what they say, so that an index holds whatever order rows come in, and repeated
texts are verified to the same spans. Beside the candidates' keys texts stay where they are as long as those keys are
under the session's broadcast threshold; beyond it they are shuffled once.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, drop_cut


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Java and Python share; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


# A run that is long enough is the same match whether the length is asked in the pattern or afterwards,
# for a match of these two takes the whole rest of its run; "assign" needs the later test.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20, 0, True),
    Rule("hex", r"[0-9a-f]{24,}", 24, 0, True),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{30,}"),
    Rule("chatbot", r"xox[abp]-[A-Za-z0-9-]{20,}"),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

ANY = True
#: most strings that a part of a pattern may stand for before it counts as anything
WIDE = 64


def trigram_query(pattern: str):
    """``True`` (no mandatory trigram), or a set of sets of trigrams: one of the sets must be there whole.

    Over lower-cased text, so that it holds for patterns of either case.
    """
    return _close(*_walk(sre_parser.parse(pattern))[:2])


def _strings(exact: frozenset[str]):
    return _or([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) if len(s) > 2 else ANY for s in exact])


def _close(exact: frozenset[str], query):
    return _and(query, _strings(exact))


def _and(a, b):
    if a is ANY or b is ANY:
        return b if a is ANY else a
    return _least(x | y for x in a for y in b)


def _or(parts: list):
    return ANY if any(p is ANY for p in parts) else _least(x for p in parts for x in p)


def _least(sets):
    """Without the sets that hold another one."""
    every = set(sets)
    return frozenset(x for x in every if not any(y < x for y in every))


def _walk(items) -> tuple[frozenset[str], object, bool]:
    """The strings at the end of the sequence, the query of what stands before, and whether those strings are all of it."""
    exact, query, whole = frozenset([""]), ANY, True
    for op, arg in items:
        part, own, all_of_it = _item(op, arg)
        if part is None or len(part) * len(exact) > WIDE:
            # what follows doesn't adjoin what was before: close the strings gathered so far
            query = _and(_close(exact, query), own if part is None else _strings(part))
            exact, whole = frozenset([""]), False
            continue
        exact = frozenset(a + b for a in exact for b in part)
        if not all_of_it:
            query, exact, whole = _close(exact, query), frozenset([""]), False
    return exact, query, whole


def _item(op, arg) -> tuple[frozenset[str] | None, object, bool]:
    """Strings that a match starts with (None: anything), its query then, and whether the strings are all of it."""
    if op is sre.LITERAL:
        return frozenset([chr(arg).lower()]), ANY, True
    if op is sre.AT:
        return frozenset([""]), ANY, True
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ANY, False
        return (frozenset(chars), ANY, True) if len(chars) <= 8 else (None, ANY, False)
    if op is sre.SUBPATTERN:
        exact, query, whole = _walk(arg[3])
        return (exact, ANY, True) if whole else (None, _close(exact, query), False)
    if op is sre.BRANCH:
        found = [_walk(x) for x in arg[1]]
        if all(whole for _, _, whole in found):
            return frozenset().union(*(e for e, _, _ in found)), ANY, True
        return None, _or([_close(e, q) for e, q, _ in found]), False
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        exact, query, whole = _walk(inner)
        if not least:
            return (exact | {""}, ANY, True) if whole and most == 1 else (None, ANY, False)
        return (exact, ANY, least == most == 1) if whole else (None, _close(exact, query), False)
    return None, ANY, False


def _trie(strings: list[str]) -> str:
    """A regex of the strings, common starts written once."""
    if strings == [""]:
        return ""
    by: dict[str, list[str]] = {}
    for x in strings:
        by.setdefault(x[0], []).append(x[1:])
    parts = [re.escape(c) + _trie(rest) for c, rest in sorted(by.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _keys() -> list[Column]:
    """A 128-bit hash of the text, null as empty."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs(text)`` -> ``(id, k1, k2, grams, found)``, a row a row, written: the rules' trigrams in a text, and the spans of rules that ask for none."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({t for q in queries if q is not ANY for x in q for t in x})
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), *_keys())
    first = "".join(sorted(re.escape(c) for c in {g[0] for g in grams}))
    # one pass: a look-ahead at every character that one of the trigrams starts with
    own = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"(?=[{first}])(?=({_trie(grams)}))"), F.lit(1))) if grams else F.array().cast("array<string>")
    rows = texts.select("text", "k1", "k2", own.alias("grams"), F.array(*[F.lit(q is ANY) for q in queries]).alias("cand"))
    rows = spans(rows, rules).withColumn("id", F.monotonically_increasing_id())  # written, so that every reader sees the same numbers
    return cut(rows.select("id", "k1", "k2", "grams", "found"), "grams")


def postings(indexed: DataFrame) -> DataFrame:
    """``index(...)`` -> ``(block, gram, rows)``: the inverted index, a bitmap of rows for each trigram and block."""
    each = indexed.select(F.bitmap_bucket_number("id").alias("block"), F.bitmap_bit_position("id").alias("at"), F.explode("grams").alias("gram"))
    return each.groupBy("block", "gram").agg(F.bitmap_construct_agg("at").alias("rows"))


def candidates(indexed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``index(...)`` -> ``(k1, k2, cand)`` of texts that pass a rule's query; ``cand`` says which, by place in ``rules``."""
    queries = [trigram_query(r.pattern) for r in rules]
    asked = [(i, c, len(x), t) for i, q in enumerate(queries) if q is not ANY for c, x in enumerate(sorted(q, key=sorted)) for t in sorted(x)]
    asked = indexed.sparkSession.createDataFrame(asked, "rule int, conj int, n int, gram string")  # as large as the rules are
    met = postings(indexed).join(F.broadcast(asked), "gram").groupBy("block", "rule", "conj", "n").agg(F.bitmap_and_agg("rows").alias("rows"), F.count("*").alias("k"))
    met = met.filter("k = n").groupBy("block", "rule").agg(F.bitmap_or_agg("rows").alias("rows"))
    met = met.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("rule", "rows"))).alias("by"))  # at most 4 KiB a rule
    at = F.bitmap_bit_position("id")

    def bit(i: int) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("by")[i], F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(id) % 8 as int))")) != 0, F.lit(False))

    rows = indexed.select("id", "k1", "k2", F.bitmap_bucket_number("id").alias("block")).join(met, "block")
    rows = rows.select("k1", "k2", F.array(*[bit(i) for i in range(len(rules))]).alias("cand")).filter(F.exists("cand", lambda x: x))
    return rows.groupBy("k1", "k2").agg(F.any_value("cand").alias("cand"))


def spans(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``rows(text, cand, ...)`` with ``found``: array of (start, ord, end, kind), sorted, of the rules that ``cand`` names.

    Positions are code points, the end exclusive; ``ord`` is the rule's place. Matches of a rule are
    leftmost and don't overlap; those of different rules may.
    """
    was = rows.columns
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"_m{i}": F.when(F.col("cand")[i], F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(none) for i, r in enumerate(rules)})
    for i, r in enumerate(rules):
        hit = F.size(f"_m{i}") > 0
        rows = rows.withColumns(
            {
                f"_g{i}": F.when(hit, F.split("text", r.pattern, -1)).otherwise(none),
                f"_k{i}": F.when(hit, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))).otherwise(none) if r.group else F.col(f"_m{i}"),
            }
        )
    every = []
    for i, r in enumerate(rules):
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)").alias("out"))

        def step(acc: Column, m: Column) -> Column:
            lo = acc["at"] + F.length(m["g"])
            hi = lo + F.length(m["m"])
            one = F.struct(lo.alias("start"), F.lit(i).alias("ord"), hi.alias("end"), F.lit(r.kind).alias("kind"))
            return F.struct(hi.alias("at"), F.when(F.length(m["k"]) >= r.least, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        zipped = F.arrays_zip(F.col(f"_m{i}").alias("m"), F.expr(f"slice(_g{i}, 1, size(_m{i}))").alias("g"), F.col(f"_k{i}").alias("k"))
        every.append(F.when(F.size(f"_m{i}") > 0, F.aggregate(zipped, start, step, lambda a: a["out"])).otherwise(start["out"]))
    return rows.select(*was, F.array_sort(F.concat(*every)).alias("found"))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs(text)`` -> ``(k1, k2, found)``: a row a text that has a span, with all its spans (see :func:`spans`)."""
    indexed = index(docs, rules)
    cand = cut(candidates(indexed, rules), "candidates")  # written, so that its size is known when the join is planned
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), *_keys())
    verified = spans(texts.join(cand, ["k1", "k2"]), rules).select("k1", "k2", "found")
    both = verified.unionByName(indexed.select("k1", "k2", "found")).filter(F.size("found") > 0)
    # a text may stand in many rows: the most spans are all those of one pass, and the passes are of different rules
    every = both.groupBy("k1", "k2").agg(F.collect_set("found").alias("f")).select("k1", "k2", F.array_sort(F.flatten("f")).alias("found"))
    out = cut(every, "spans")
    drop_cut(indexed)
    drop_cut(cand)
    return out


def _list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of(i: int):
    return lambda s: s["ord"] == i


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a row: ``doc_id``, counts of the base kinds, the digest of the base spans, and all spans.

    Null text counts as empty, texts are scanned whole however long, rows repeat as they do in ``docs``,
    an empty table gives an empty table, other columns are ignored whatever their names.
    """
    base = [i for i, r in enumerate(rules) if r.base]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys()).join(find(docs.select("text"), rules), ["k1", "k2"], "left")
    rows = rows.withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)")))
    count = [F.size(F.filter("found", _of(i))).cast("long").alias(f"n_{rules[i].kind}") for i in base]
    own = F.filter("found", lambda s: s["ord"].isin(base))
    return rows.select("doc_id", *count, F.sha2(_list(own).cast("binary"), 256).alias("base_sha256"), _list(F.col("found")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span of :func:`find` replaced by ``[kind]``; overlapping spans become one, named by the first.

    All rows and columns stay, whatever their names (null text too); ``n_chars``, if there, follows the
    text. An empty table gives an empty table.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text", *_keys()).join(find(docs.select("text"), rules), ["k1", "k2"], "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        text = F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, text).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("found", start, step, lambda a: F.concat(a["out"], F.col("text").substr(a["at"] + 1, F.length("text"))))
    rows = rows.select("doc", F.col("found").isNotNull().alias("hit"), F.when(F.col("found").isNotNull(), clean).otherwise(F.col("text")).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("doc")["n_chars"])}
    return rows.select(*[new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns])


#: the same rules in DuckDB, positions from the parts between matches
ORACLE = (
    "with d as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents), f as ("
    + " union all ".join(
        f"select r, {i} as o, '{r.kind}' as kind, regexp_extract_all(t, '{p}', 0) as m, regexp_split_to_array(t, '{p}') as g, regexp_extract_all(t, '{p}', {r.group}) as k, {r.least} as least from d"
        for i, r in enumerate(RULES)
        for p in [r.pattern.replace("'", "''")]
    )
    + """), s as (select r, o, kind, unnest(range(1, len(m) + 1)) as i, m, g, k, least from f where len(m) > 0),
    p as (select r, o, kind, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as bigint) as a, length(m[i]) as n from s where length(k[i]) >= least),
    x as (select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
      string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, o) filter (o < 3) as base, string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, o) as spans from p group by r)
    select doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access, cast(coalesce(n_hex, 0) as bigint) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join x using (r)"""
)
