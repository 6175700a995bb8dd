"""Places in a total order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.lineage import checkpointed


def placed(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 in the order, which must be total.

    A distributed sort is checkpointed; a row's place is its place in its partition and the rows of the partitions before,
    of which there is one small count each.
    """
    was = rows.columns
    rows = checkpointed(rows.orderBy(*order)).withColumns({"_id": F.monotonically_increasing_id(), "_part": F.spark_partition_id()})
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.col("_id").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(start), "_part").select(*was, (F.col("_start") + own).alias(name))
