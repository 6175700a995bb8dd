"""Queries whose rows come through a stream over everything that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.dialect import DUCK, SPARK, plain, run
from strata.operators.lineage import shared_dir
from strata.plans import engine
from strata.sources.relations import with_relations
from strata.streaming import changes, rollup


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def stream_file_changes(spark: SparkSession, d: str) -> DataFrame:
    """Arriving files against the stored prints."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), "doc_id", F.lit(".txt"))
    files = _stream(spark, d, "documents").select(path.alias("path"), F.col("text").alias("content"))
    stored = run(spark, d, with_relations(SPARK, "select path, hash from stored_print"))
    return changes.land(changes.changes(files, stored), shared_dir(spark))


def stream_rejection_insights(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of rejections as a stream; reasons that recur in the last days."""
    k = F.get_json_object("props", "$.k").cast("int") % 8
    rejected = _stream(spark, d, "events").filter("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("ts"), F.when(k < 7, k).alias("reason"))
    daily = rollup.run_once(changes.rejections(rejected), ["day", "reason"])
    return changes.insights(daily, engine.FEEDBACK_AS_OF)


_CHANGES = "select path, case when hash is null then 'added' when hash = now then 'unchanged' else 'modified' end as state from (select path, md5(content) as now from file) f left join stored_print using (path)"

_INSIGHTS = "select reason, count(*) as n, cast(round(least(0.9, 0.3 + 0.1 * count(*)), 2) as double) as confidence from feedback_event where feedback = 'rejected' and reason is not null and day >= date '2023-12-30' group by reason having count(*) >= 3"

ORACLES = {"stream_file_changes": plain(with_relations(DUCK, _CHANGES)), "stream_rejection_insights": plain(with_relations(DUCK, _INSIGHTS))}
QUERIES = {k: globals()[k] for k in ORACLES}
