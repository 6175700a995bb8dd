"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, as a full URI.

    Only where the setting is absent (tests on one machine) a local folder is made and used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        global _made
        _made = _made or tempfile.mkdtemp(prefix="strata-")
        found = f"file://{_made}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(found)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


_made: str | None = None


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strata/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strata_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a :func:`cut` that no later plan reads."""
    path = getattr(df, "_strata_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
