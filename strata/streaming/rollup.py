"""Streaming form of the daily rollup, and how a stream's updates become a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.lineage import new_path


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """``events(ts, value)``, streaming or not -> one row a day, updated until the watermark has passed it."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("requests"), F.sum(F.floor("value")).cast("long").alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "requests", "total")


def run_once(stream: DataFrame, key: list[str], path: str | None = None) -> DataFrame:
    """Everything that is there, then stop; the last row of each key.

    In update mode, so that the watermark drops state. A batch's changed rows go to a folder of its own number, which a
    repeated batch overwrites; nothing of the result passes through the driver.
    """
    spark = stream.sparkSession
    path = path or new_path(spark, "stream")

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/b{n}")

    empty = spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0).cast("long"))
    empty.write.mode("overwrite").parquet(f"{path}/rows/none")  # so that a stream without a batch is an empty table
    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(empty.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
    rest = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*key, "r.*").select(*stream.columns)
