"""Cutting a plan's lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder only where it is unset, as in tests on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        global _made
        _made = _made or tempfile.mkdtemp(prefix="strata-")
        found = f"file://{_made}"
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it keeps how rows are partitioned, and a lost executor reads it again."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/strata/{what}-{uuid.uuid4().hex}"
