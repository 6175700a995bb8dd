"""Streams of file changes and of rejected feedback."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(files: DataFrame, stored: DataFrame) -> DataFrame:
    """``files(path, content)``, streaming or not, against ``stored(path, hash)`` -> ``(path, state)``, a row a row.

    Stateless: the stored prints are read anew with every micro-batch. Null content counts as empty, a null path is new.
    """
    seen = files.select("path", F.md5(F.coalesce("content", F.lit(""))).alias("now"))
    state = F.when(F.col("hash").isNull(), "added").when(F.col("hash") == F.col("now"), "unchanged").otherwise("modified")
    return seen.join(stored.select("path", "hash"), "path", "left").select("path", state.alias("state"))


def rejections(events: DataFrame, late: str = "2 days") -> DataFrame:
    """``events(ts, reason)`` of rejected feedback -> ``(day, reason, n)``; state is a count a day and reason, dropped past the watermark."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.filter("reason is not null").groupBy(F.window("ts", "1 day").alias("w"), "reason").agg(F.count("*").alias("n"))
    return out.select(F.to_date("w.start").alias("day"), "reason", "n")


def insights(daily: DataFrame, as_of: str, days: int = 30, least: int = 3) -> DataFrame:
    """Daily counts -> ``(reason, n, confidence)`` of reasons rejected ``least`` times and more in the last ``days``."""
    recent = daily.filter(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days)).groupBy("reason").agg(F.sum("n").alias("n"))
    return recent.filter(F.col("n") >= least).select("reason", "n", F.round(F.least(F.lit(0.9), 0.3 + 0.1 * F.col("n")), 2).alias("confidence"))


def land(stream: DataFrame, folder: str) -> DataFrame:
    """Append everything that is there to Parquet under ``folder``, then stop; what was written."""
    tag = uuid.uuid4().hex
    path = f"{folder}/stream-{tag}"
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
