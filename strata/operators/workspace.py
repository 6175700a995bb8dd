"""Registered projects: which one a file belongs to, and how the registry changes.

``projects(project_id, name, root, registered_at, last_accessed)``; paths are absolute with ``/``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: what a folder holds that is the root of a project
MARKERS = (".git", "pyproject.toml", "package.json", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "Makefile")


def ancestors(path: Column) -> Column:
    """The folders above a path, deepest first; the path itself is not one."""
    parts = F.split(F.regexp_replace(path, r"/+$", ""), "/")
    up = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.size(parts) > 1, F.transform(up, lambda x: F.when(x == "", "/").otherwise(x))).otherwise(F.array().cast("array<string>"))


def route(files: DataFrame, projects: DataFrame) -> DataFrame:
    """``files(file_path)`` -> ``(file_path, project_id, root)``: the project with the deepest root above the file; none: nulls.

    A file meets roots by an equi join on each of the folders above it, whatever their depth.
    """
    up = files.select("file_path").distinct().select("file_path", F.explode(F.concat(F.array("file_path"), ancestors(F.col("file_path")))).alias("root"))
    hit = up.join(projects.select("project_id", "root"), "root").groupBy("file_path").agg(F.max_by(F.struct("project_id", "root"), F.struct(F.size(F.split("root", "/")), "root")).alias("p"))
    return files.select("file_path").join(hit, "file_path", "left").select("file_path", F.col("p.project_id").alias("project_id"), F.col("p.root").alias("root"))


def discover(files: DataFrame, entries: DataFrame, home: str = "/root", own: str = ".strata") -> DataFrame:
    """``files(file_path)`` -> ``(file_path, root)``: the nearest folder above that holds a marker, not above ``home``; none: null.

    ``entries(path)`` are files and folders that exist; ``own`` marks a project that is indexed already.
    """
    name = F.regexp_extract("path", r"([^/]+)/?$", 1)
    roots = entries.filter(name.isin(own, *MARKERS)).select(F.regexp_replace("path", r"/[^/]+/?$", "").alias("root")).distinct()
    over = home.rstrip("/").rpartition("/")[0] or "/"
    above = F.array_append(ancestors(F.lit(over)), F.lit(over))
    up = files.select("file_path").distinct().select("file_path", F.explode(F.array_except(ancestors(F.col("file_path")), F.array_append(above, F.lit("/")))).alias("root"))
    hit = up.join(roots, "root", "left_semi").groupBy("file_path").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.select("file_path").join(hit, "file_path", "left")


def register(projects: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with ``new`` projects; one that is there already keeps its first ``registered_at`` and takes the rest."""
    by = Window.partitionBy("project_id").orderBy(F.desc("last_accessed"), F.desc("root"))
    last = new.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")
    was = projects.select("project_id", F.col("registered_at").alias("_first"))
    got = last.join(was, "project_id", "left").withColumn("registered_at", F.coalesce("_first", "registered_at")).drop("_first")
    return projects.join(last.select("project_id"), "project_id", "left_anti").unionByName(got.select(*projects.columns))


def unregister(projects: DataFrame, gone: DataFrame) -> DataFrame:
    return projects.join(gone.select("project_id"), "project_id", "left_anti")


def touch(projects: DataFrame, seen: DataFrame) -> DataFrame:
    """``last_accessed`` moved on to the latest ``at`` of ``seen(project_id, at)``."""
    last = seen.groupBy("project_id").agg(F.max("at").alias("_at"))
    return projects.join(last, "project_id", "left").withColumn("last_accessed", F.greatest("last_accessed", "_at")).select(*projects.columns)


def held(accesses: DataFrame, most: int = 5) -> DataFrame:
    """``accesses(project_id, at)`` -> the ``most`` projects used last, which stay loaded; the others are evicted."""
    return accesses.groupBy("project_id").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "project_id").limit(most)
