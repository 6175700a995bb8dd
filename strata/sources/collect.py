"""What the operators read from disk: files of a kind, commits, and the registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.tree import read_tree

#: fixed values: suffixes of files that conventions and services are looked for in, and the characters a file may have
CONVENTION_SUFFIXES = (".py", ".ts", ".tsx", ".js", ".jsx")
SERVICE_SUFFIXES = (".py", ".ts", ".js", ".tsx", ".jsx", ".go", ".java", ".kt", ".kts", ".rs", ".rb", ".php", ".cs", ".swift", ".ex", ".exs", ".scala", ".env")
LONGEST = 500_000
PROJECT = "project_id string, name string, root string, registered_at timestamp, last_accessed timestamp"


def convention_files(spark: SparkSession, root: str) -> DataFrame:
    return read_tree(spark, root, CONVENTION_SUFFIXES).filter(F.length("content") < LONGEST)


def service_files(spark: SparkSession, root: str, service: str) -> DataFrame:
    """``(service, file_path, content)`` of one service's repository."""
    return read_tree(spark, root, SERVICE_SUFFIXES).filter(F.length("content") < LONGEST).select(F.lit(service).alias("service"), "file_path", "content")


def newest_commits(commits: DataFrame, most: int = 500) -> DataFrame:
    """``commits(sha, committed_at, ...)``: the ``most`` newest, ties by sha."""
    return commits.orderBy(F.desc("committed_at"), "sha").limit(most)


def newest(runs: DataFrame, at: str = "recorded_at", most: int | None = None) -> DataFrame:
    """Runs, insights and the like, newest first; with ``most`` so many."""
    got = runs.orderBy(F.desc_nulls_last(at))
    return got.limit(most) if most else got


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registered projects from a JSON file of one object a project; times without a zone are UTC (the session's zone)."""
    return spark.read.schema(PROJECT).json(path, multiLine=True)


def write_registry(projects: DataFrame, path: str) -> None:
    """The registry as JSON lines under ``path``, replaced whole by Spark's committer, so that readers never see a part."""
    projects.write.mode("overwrite").json(path)


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """Rows of a table by key: nodes, fingerprints, decisions, contracts, intents or projects."""
    return table.filter(F.col(key) == F.lit(value))
