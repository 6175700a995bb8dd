"""Decisions: relevance to files, conflicts, drift, ids and what commits say.

Frames: ``decisions(id, status, supersedes, review_by, created_at, tags, code_anchors, constraints, ...)`` as
``sources.records.read_decisions`` gives them; ``asked(file_path)``; ``files(file_path, content)``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.lineage import checkpointed
from strata.operators.ranking import placed

#: fixed values: statuses that a search leaves out
CLOSED = ("superseded", "expired")
#: fixed values: words that mark a commit as a decision
KEYWORDS = (
    "decided", "decision", "chose", "chosen", "opted for", "switched to", "migrated from", "replaced", "instead of", "rather than",
    "because", "reason:", "rationale:", "why:", "trade-off", "tradeoff", "considered", "evaluated", "compared",
    "compliance", "regulation", "requirement", "sla", "must not", "cannot", "forbidden", "prohibited",
    "breaking change", "breaking:", "deprecated", "removed", "adr", "architecture decision", "design decision", "rfc",
)
#: fixed values: first lines of commits that aren't looked at
NOISE = (r"^merge\s", r"^wip\b", r"^fix\s*(typo|lint|format|style)", r"^chore\s*:", r"^bump\s+version", r"^update\s+lock", r"^auto-generated")
#: fixed values: words that make a commit's decision likelier
STRONG, REASON = ("adr", "architecture decision", "design decision"), ("because", "reason:", "rationale:")
#: anchors that a task holds when overlaps are looked for, shares that pass them, rows of a batch that is given, and bounds of line numbers
HELD, SHARES, GIVEN, FIRST, LAST = 2_000_000, 32, 20_000, -(2**63), 2**63 - 1


def is_open(status: Column) -> Column:
    return ~status.isin(*CLOSED)


def is_stale(review_by: Column, as_of: Column) -> Column:
    return F.coalesce(as_of > review_by, F.lit(False))


def is_expired(constraints: Column, as_of: Column) -> Column:
    """Whether a hard constraint's expiry has passed."""
    return F.coalesce(F.exists(constraints, lambda c: F.coalesce(c["is_hard"], F.lit(False)) & F.coalesce(as_of > c["expiry_date"], F.lit(False))), F.lit(False))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def head(path: Column, parts: int = 3) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, parts), "/")


def anchors(decisions: DataFrame) -> DataFrame:
    """``(id, file_path, line_start, line_end, content_hash, place)``, a row an anchor."""
    a = decisions.select("id", F.posexplode("code_anchors").alias("place", "a"))
    return a.select("id", F.col("a.file_path").alias("file_path"), F.col("a.line_start").alias("line_start"), F.col("a.line_end").alias("line_end"), F.col("a.content_hash").alias("content_hash"), "place")


def relevance(decisions: DataFrame, asked: DataFrame, least: float = 0.1) -> DataFrame:
    """Open decisions -> ``(id, score)`` of ``least`` and more.

    An anchor's file is asked for: 1; one of its folder is: 0.5; one with the same first three parts: 0.2; else 0. A
    decision without anchors: 0.1. A rung is an equi join on a derived key, so no file meets every other.
    """
    live = decisions.filter(is_open(F.col("status")))
    a = anchors(live).select("id", "file_path").distinct()
    keys = lambda d: d.select("*", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), k.alias("key")) for s, k in ((1.0, F.col("file_path")), (0.5, folder(F.col("file_path"))), (0.2, head(F.col("file_path"))))])).alias("k")).select("*", "k.*").drop("k")
    want = keys(asked.select("file_path").distinct()).select("score", "key").distinct()
    hit = keys(a).select("id", "score", "key").join(want, ["score", "key"], "left_semi").groupBy("id").agg(F.max("score").alias("score"))
    bare = live.filter(F.coalesce(F.size("code_anchors"), F.lit(0)) <= 0).select("id", F.lit(0.1).alias("score"))
    return hit.unionByName(bare).filter(F.col("score") >= least)


def by_files(decisions: DataFrame, asked: DataFrame, most: int | None = None, least: float = 0.1) -> DataFrame:
    """:func:`relevance` with ``place``, best first, ties by id; with ``most`` the first ones."""
    scored = relevance(decisions, asked, least)
    got = scored.orderBy(F.desc("score"), "id").limit(most) if most else scored
    return placed(got, F.desc("score"), "id").withColumn("place", F.col("place") + 1)


def by_tags(decisions: DataFrame, tags: list[str]) -> DataFrame:
    return decisions.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))


def conflicts(decisions: DataFrame) -> DataFrame:
    """Of active decisions: ``(kind, a_id, b_id, file_path)``: what :func:`superseded` and :func:`overlaps` give."""
    old, both = superseded(decisions), overlaps(decisions)
    return old.select(F.lit("superseded").alias("kind"), "a_id", "b_id", F.lit(None).cast("string").alias("file_path")).unionByName(both.select(F.lit("overlap").alias("kind"), "a_id", "b_id", "file_path"))


def superseded(decisions: DataFrame) -> DataFrame:
    """Active decisions that another, active too, names as superseded: ``(a_id, b_id)``, the first by id that names it and it."""
    live = decisions.filter("status = 'active'")
    old = live.filter("supersedes is not null").select(F.col("id").alias("a_id"), F.col("supersedes").alias("b_id"))
    return old.join(live.select(F.col("id").alias("b_id")), "b_id", "left_semi").groupBy("b_id").agg(F.min("a_id").alias("a_id")).select("a_id", "b_id")


def overlaps(decisions: DataFrame) -> DataFrame:
    """Active decisions whose anchors share lines of a file, or either is for the whole file: ``(a_id, b_id, file_path)``.

    A pair is given once, the smaller id first, with the file of the first anchor of ``a_id`` that meets one of the other.
    Decisions are dealt twice: into blocks of some ``HELD`` anchors, one of which a task holds, and into ``SHARES``, one of
    which streams past a block. All anchors of a pair meet in one task, so pairs are not shuffled: decisions are, once for
    each share and each block. The pairs themselves may grow with the square of the decisions that a file has.
    """
    each = lambda name, kind: F.transform("code_anchors", lambda a: a[name].cast(kind))
    live = decisions.filter("status = 'active' and id is not null and size(code_anchors) > 0")
    live = checkpointed(live.select("id", each("file_path", "string").alias("paths"), each("line_start", "long").alias("starts"), each("line_end", "long").alias("ends")))
    blocks = (live.agg(F.sum(F.size("paths"))).first()[0] or 0) // HELD + 1
    held = live.select("*", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    past = live.select("*", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SHARES)).cast("int").alias("share"), F.lit(1).alias("side")).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = held.unionByName(past).withColumn("cell", F.col("share") * blocks + F.col("block")).repartitionById(SHARES * blocks, "cell").sortWithinPartitions("cell", "side", "id")
    return dealt.select("cell", "side", "id", "paths", "starts", "ends").mapInArrow(_meeting(), "a_id string, b_id string, file_path string")


def _meeting():
    """What a task does with its cells; made here, so that workers get it with its parts and import nothing of this package."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell the decisions that are held come first, then those that pass, by id."""
        cell, held, block = None, [], None
        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if key[lo] // 2 != cell:
                    if block:
                        yield from block.rest()
                    cell, held, block = key[lo] // 2, [], None
                if key[lo] % 2 == 0:
                    held.append(b.slice(lo, hi - lo))
                else:
                    block = block or Block(held)
                    held = []
                    yield from block.met(b.slice(lo, hi - lo))
        if block:
            yield from block.rest()

    def spans(b: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Anchors a decision, and of each anchor its path, first and last line; whole files reach over all lines, no last line meets those alone."""
        whole = b.column(4).flatten().is_null().to_numpy(zero_copy_only=False)
        first = b.column(4).flatten().fill_null(FIRST).to_numpy()
        last = np.where(whole, LAST, b.column(5).flatten().fill_null(FIRST).to_numpy())
        return b.column(3).value_lengths().to_numpy(), b.column(3).flatten(), first, last

    class Block:
        """Anchors of the decisions that a task holds, by file and then by id."""

        def __init__(self, held: list[pa.RecordBatch]):
            parts = [spans(b) for b in held]
            ids = [i for b in held for i in b.column(2).to_pylist()]
            self.ids = sorted(set(ids))
            rank = {x: i for i, x in enumerate(self.ids)}
            rank = np.repeat(np.array([rank[x] for x in ids], np.int32), np.concatenate([s[0] for s in parts]) if parts else 0)
            paths = pa.concat_arrays([s[1] for s in parts]).dictionary_encode() if parts else pa.array([], pa.string()).dictionary_encode()
            self.files, file = paths.dictionary, paths.indices.fill_null(-1).to_numpy()
            order = np.lexsort((rank, file))
            order = order[np.searchsorted(file[order], 0) :]
            self.rank, self.first, self.last = rank[order], *(np.concatenate([s[k] for s in parts])[order] if parts else np.array([], np.int64) for k in (2, 3))
            self.at = np.searchsorted(file[order], np.arange(len(self.files) + 1)).tolist()
            self.named = pa.array(self.ids, pa.string())
            self.best = np.full(len(self.ids), -1, np.int32)
            self.now, self.rows = None, []
            self.out, self.n = [], 0

        def met(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            n, paths, first, last = spans(b)
            file = pc.index_in(paths, value_set=self.files, skip_nulls=True).fill_null(-1).to_numpy()
            ends = np.cumsum(n).tolist()
            for i, lo, hi in zip(b.column(2).to_pylist(), [0, *ends], ends):
                if i != self.now:
                    yield from self.settle()
                    self.now, self.rows = i, []
                self.rows.append((np.arange(hi - lo), file[lo:hi], first[lo:hi], last[lo:hi]))

        def settle(self) -> Iterator[pa.RecordBatch]:
            """The pairs of the decision that has passed; of its anchors the first one counts, so it comes last."""
            if self.now is None:
                return
            place, file, first, last = (np.concatenate(x) for x in zip(*self.rows))
            back = np.argsort(place, kind="stable")[::-1]
            after = bisect_right(self.ids, self.now)
            for f, x, y in zip(file[back].tolist(), first[back].tolist(), last[back].tolist()):
                if f >= 0:
                    lo, hi = self.at[f], self.at[f + 1]
                    lo += int(self.rank[lo:hi].searchsorted(after))
                    meet = (self.first[lo:hi] <= y) & (self.last[lo:hi] >= x)
                    self.best[self.rank[lo:hi][meet]] = f
            hits = np.flatnonzero(self.best[after:] >= 0) + after
            if len(hits):
                self.out.append((self.now, hits, self.best[hits]))
                self.best[hits] = -1
                self.n += len(hits)
            if self.n >= GIVEN:
                yield from self.given()

        def given(self) -> Iterator[pa.RecordBatch]:
            if self.out:
                a = pa.array([x[0] for x in self.out], pa.string()).take(pa.array(np.repeat(np.arange(len(self.out)), [len(x[1]) for x in self.out])))
                b, f = (np.concatenate([x[k] for x in self.out]) for k in (1, 2))
                for lo in range(0, self.n, GIVEN):
                    cut = slice(lo, lo + GIVEN)
                    yield pa.RecordBatch.from_arrays([a[cut], self.named.take(pa.array(b[cut])), self.files.take(pa.array(f[cut])).cast(pa.string())], ["a_id", "b_id", "file_path"])
                self.out, self.n = [], 0

        def rest(self) -> Iterator[pa.RecordBatch]:
            yield from self.settle()
            yield from self.given()

    return met


def next_id(records: DataFrame, prefix: str = "DEC") -> DataFrame:
    """One row ``next_id``: the greatest number of an id plus one, three digits and more; without records 001."""
    n = F.coalesce(F.max(F.regexp_extract("id", r"([0-9]+)$", 1).try_cast("int")), F.lit(0)) + 1
    return records.agg(n.alias("n")).select(F.concat(F.lit(f"{prefix}-"), F.when(F.col("n") > 999, F.col("n").cast("string")).otherwise(F.lpad(F.col("n").cast("string"), 3, "0"))).alias("next_id"))


def last_of_each(records: DataFrame) -> DataFrame:
    """Of records with one id the one whose file comes last by name."""
    by = Window.partitionBy("id").orderBy(F.desc("file_path"))
    return records.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def region_hash(content: Column, first: Column, last: Column) -> Column:
    """SHA-256 (16 hex digits) of lines ``first`` to ``last``, both included; without them of the whole text."""
    lines = F.split(content, "\n", -1)
    region = F.when(first.isNull(), content).otherwise(F.array_join(F.slice(lines, first, F.greatest(F.coalesce(last, first) - first + 1, F.lit(0))), "\n"))
    return F.substring(F.sha2(region, 256), 1, 16)


def drift(decisions: DataFrame, files: DataFrame, as_of: Column) -> DataFrame:
    """Of active decisions: ``(id, problem, level, file_path)``.

    ``stale``: past its review date (medium). ``expired constraint``: a hard one (high). ``orphaned anchor``: of a file that
    is gone (medium; high if the decision is stale too). ``changed anchor``: the anchored lines no longer have their hash (medium).
    """
    live = decisions.filter("status = 'active'").withColumns({"stale": is_stale(F.col("review_by"), as_of), "expired": is_expired(F.col("constraints"), as_of)})
    none = F.lit(None).cast("string").alias("file_path")
    own = live.filter("stale").select("id", F.lit("stale").alias("problem"), F.lit("medium").alias("level"), none)
    late = live.filter("expired").select("id", F.lit("expired constraint").alias("problem"), F.lit("high").alias("level"), none)
    a = anchors(live).join(files.select("file_path", "content", F.lit(True).alias("there")).dropDuplicates(["file_path"]), "file_path", "left")
    gone = a.filter("there is null").select("id", "file_path").distinct().join(live.select("id", "stale"), "id")
    gone = gone.groupBy("id", "stale").agg(F.min("file_path").alias("file_path")).select("id", F.lit("orphaned anchor").alias("problem"), F.when(F.col("stale"), "high").otherwise("medium").alias("level"), "file_path")
    now = region_hash(F.coalesce("content", F.lit("")), F.col("line_start"), F.col("line_end"))
    changed = a.filter(F.col("there") & F.col("content_hash").isNotNull() & (now != F.col("content_hash"))).select("id", F.lit("changed anchor").alias("problem"), F.lit("medium").alias("level"), "file_path").distinct()
    return own.unionByName(late).unionByName(gone).unionByName(changed)


def drift_for_files(decisions: DataFrame, asked: DataFrame) -> DataFrame:
    """Active decisions anchored in files that change: ``(id, file_path, anchors, level)``."""
    a = anchors(decisions.filter("status = 'active'")).join(asked.select("file_path").distinct(), "file_path", "left_semi")
    return a.groupBy("id", "file_path").agg(F.count("*").alias("anchors")).withColumn("level", F.lit("low"))


def rot(decisions: DataFrame, files: DataFrame, as_of: Column, least: int = 5, share: float = 0.3) -> DataFrame:
    """One row ``(total, stale, orphaned, rot)`` over all decisions; one may count as stale and as orphaned."""
    gone = anchors(decisions).join(files.select("file_path").distinct(), "file_path", "left_anti").select("id").distinct().withColumn("gone", F.lit(True))
    got = decisions.join(gone, "id", "left").agg(F.count("*").alias("total"), F.count_if(is_stale(F.col("review_by"), as_of)).alias("stale"), F.count("gone").alias("orphaned"))
    return got.withColumn("rot", (F.col("total") >= least) & ((F.col("stale") + F.col("orphaned")) / F.greatest(F.col("total"), F.lit(1)) >= share))


def keywords(message: Column, words: tuple[str, ...] = KEYWORDS) -> Column:
    """The words that a message holds anywhere, whatever their case."""
    low = F.lower(message)
    return F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in words]))


def confidence(message: Column, hits: Column, changed: Column) -> Column:
    """0.3, more for keywords, a long message, few files, and words that give reasons; 0.8 at most."""
    low, n = F.lower(message), F.length(message)
    has = lambda words, x: F.when(F.greatest(*[low.contains(w) for w in words]), x).otherwise(0.0)
    return F.least(
        F.lit(0.8),
        F.lit(0.3) + F.least(F.lit(0.2), hits * 0.05) + F.when(n > 200, 0.1).otherwise(0.0) + F.when(n > 500, 0.1).otherwise(0.0) + F.when(changed.between(1, 5), 0.05).otherwise(0.0) + has(STRONG, 0.15) + has(REASON, 0.1),
    )


def candidates(commits: DataFrame, words: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """``commits(sha, message, files array<string>)`` -> ``(sha, title, decision, context, keywords, confidence, files, anchors)``.

    Commits whose first line is noise, or that hold no keyword, are left out. A title has 80 characters at most; 20
    files and 10 anchors of them are kept.
    """
    text = F.trim(F.coalesce("message", F.lit("")))
    first = F.trim(F.substring_index(text, "\n", 1))
    rest = F.regexp_replace(F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(F.lit("")), r"^\s+|\s+$", "")
    quiet = F.lower(first).rlike("|".join(NOISE))
    files = F.coalesce("files", F.array().cast("array<string>"))
    rows = commits.withColumns({"first": first, "rest": rest, "keywords": keywords(text, words)}).filter(~quiet & (F.size("keywords") > 0))
    title = F.when(F.length("first") > 80, F.concat(F.substring("first", 1, 77), F.lit("..."))).otherwise(F.col("first"))
    sure = F.round(confidence(text, F.size("keywords"), F.size(files)), 2)
    return rows.select("sha", title.alias("title"), F.col("first").alias("decision"), F.col("rest").alias("context"), "keywords", sure.alias("confidence"), F.slice(files, 1, 20).alias("files"), F.slice(files, 1, 10).alias("anchors"))


def drafts(found: DataFrame) -> DataFrame:
    """Candidates as draft decision records, anchored to their files."""
    anchor = F.transform("anchors", lambda p: F.struct(p.alias("file_path"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(None).cast("string").alias("symbol_name"), F.lit(None).cast("string").alias("content_hash")))
    return found.select(F.concat(F.lit("MINED-"), F.substring("sha", 1, 8)).alias("id"), "title", F.lit("draft").alias("status"), "context", "decision", F.array(F.lit("mined")).alias("tags"), anchor.alias("code_anchors"))


def saved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records after ``new`` ones are saved: one of each id, the new one."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def shorthand(path: Column, first: Column, last: Column) -> Column:
    """An anchor as ``path``, ``path:n`` or ``path:n-m``."""
    return F.when(first.isNull(), path).when(F.coalesce(last, first) == first, F.concat_ws(":", path, first)).otherwise(F.concat(path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string")))


def with_shorthand(decisions: DataFrame) -> DataFrame:
    """Records with anchors in their short form, as they are kept in files."""
    return decisions.withColumn("code_anchors", F.transform("code_anchors", lambda a: shorthand(a["file_path"], a["line_start"], a["line_end"])))
