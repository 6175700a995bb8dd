"""Ranking context items and packing them into a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Four characters a token, rounded up; empty: none."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def usable(total: int, reserved: int = 0, margin: float = 0.1) -> int:
    raw = total - reserved
    return max(0, raw - int(raw * margin))


def rank(items: DataFrame) -> DataFrame:
    """Adds ``place`` within a request: priority, then fresher, then smaller, then by ordinal."""
    by = Window.partitionBy("request").orderBy("rank", F.desc("freshness"), "tokens", "ordinal")
    return items.withColumn("place", F.row_number().over(by))


def pack(items: DataFrame, budget: int) -> DataFrame:
    """``items(request, rank, freshness, tokens, ordinal)`` -> ``(request, ordinal, taken)``: in order, what still fits."""
    return choose(items, budget, cut_first=False).select("request", "ordinal", "taken")


def choose(items: DataFrame, budget: int, cut_first: bool = True) -> DataFrame:
    """``items(request, rank, freshness, tokens, ordinal)`` -> ``(request, ordinal, taken, cut)``.

    An item that doesn't fit is passed over and the next one tried. With ``cut_first`` one of rank 0 that doesn't fit while
    nothing is taken is taken all the same, and marked to be cut; it uses up the budget. No budget: nothing is taken.

    Items stream by, sorted by request and order, so a request of any size takes one pass and no memory; requests are
    dealt over tasks by a hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, any_ = object(), 0, False
        for b in batches:
            taken, cut = [], []
            for request, rank, tokens in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if request != now:
                    now, used, any_ = request, 0, False
                fits = budget > 0 and used + tokens <= budget
                force = cut_first and budget > 0 and not fits and not any_ and rank == 0
                taken.append(fits or force)
                cut.append(force)
                used = used + tokens if fits else budget if force else used
                any_ = any_ or fits or force
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(taken, pa.bool_()), pa.array(cut, pa.bool_())], ["request", "ordinal", "taken", "cut"])

    kinds = {c: items.schema[c].dataType.simpleString() for c in ("request", "ordinal")}
    ordered = items.select("request", "ordinal", "rank", "tokens", "freshness").repartition("request").sortWithinPartitions("request", "rank", F.desc("freshness"), "tokens", "ordinal")
    return ordered.select("request", "ordinal", "rank", "tokens").mapInArrow(run, f"request {kinds['request']}, ordinal {kinds['ordinal']}, taken boolean, cut boolean")


def truncate(lines: DataFrame, available: int) -> DataFrame:
    """``lines(path, no, line)`` -> ``(path, kept)``: the longest run of first lines within the budget of tokens (a prefix sum)."""
    used = F.sum(F.ceil((F.length("line") + 1) / 4)).over(Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("_used", used).groupBy("path").agg(F.coalesce(F.max(F.when(F.col("_used") <= available, F.col("no"))), F.lit(0)).cast("long").alias("kept"))
