"""The code graph of a source tree: built whole, or brought up to date by what changed.

``files(file_path, content)`` -> nodes, edges and fingerprints, each by column expressions over all files at once; a
build is three plans, not a loop over files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import drift, extract, graph

NODE = ("node_id", "kind", "name", "qualified_name", "file_path", "line_start", "line_end", "language", "is_test", "is_generated", "is_async", "is_entry_point", "docstring")


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    prints: DataFrame


def empty(like: Graph) -> Graph:
    return Graph(like.nodes.limit(0), like.edges.limit(0), like.prints.limit(0))


def nodes(files: DataFrame) -> DataFrame:
    """Module, class, function and interface nodes with ``NODE``, one of each id (the first by line)."""
    m = extract.modules(files).withColumns({"is_async": F.lit(False), "docstring": F.lit(None).cast("string")})
    own = m.select("file_path", "is_test", "is_generated")
    d = extract.structured(files).join(own, "file_path").withColumn("is_entry_point", F.lit(False))
    every = m.select(*NODE).unionByName(d.select(*NODE))
    rest = [c for c in NODE if c not in ("node_id", "line_start")]
    # of equal ids in one file the first by line, as one struct so that its columns stay together
    first = every.groupBy("node_id").agg(F.min(F.struct("line_start", *rest)).alias("n"))
    return first.select("node_id", "n.*").select(*NODE)


def full(files: DataFrame) -> Graph:
    """The graph of all files; edges whose target isn't a node are left out."""
    n = nodes(files)
    e = extract.edges(files).select("source_id", "target_id", "kind", "confidence", "is_type_only").unionByName(extract.inherits(files)).unionByName(extract.re_exports(files))
    return Graph(n, graph.admit(e.dropDuplicates(["source_id", "target_id", "kind"]), n), drift.fingerprints(files))


def incremental(was: Graph, files: DataFrame) -> Graph:
    """The graph after the files changed: what is gone or changed is removed with its edges, what is new or changed is read anew.

    Edges into a changed file from one that didn't change go with it, unless that file's imports are read again; they
    are here, for the import edges of all files are planned over their lines anyway, and only nodes are kept from before.
    """
    state = drift.classify(drift.fingerprints(files), was.prints)
    stale = state.filter(F.col("state") != "same").select("file_path")
    kept, left = graph.remove_files(was.nodes, was.edges, stale)
    fresh = files.join(stale, "file_path", "left_semi")
    n = kept.unionByName(nodes(fresh))
    e = extract.resolve(extract.imports(fresh), files)
    e = extract.as_edges(e, files).select("source_id", "target_id", "kind", "confidence", "is_type_only").unionByName(extract.inherits(fresh)).unionByName(extract.re_exports(fresh))
    # edges of unchanged files into changed ones were removed with them: their ends are still known by id, so they come back
    back = was.edges.join(kept.select(F.col("node_id").alias("source_id")), "source_id", "left_semi").join(kept.select(F.col("node_id").alias("target_id")), "target_id", "left_anti")
    every = left.unionByName(e).unionByName(back).dropDuplicates(["source_id", "target_id", "kind"])
    same = was.prints.join(stale, "file_path", "left_anti")
    return Graph(n, graph.admit(every, n), same.unionByName(drift.fingerprints(fresh)))


def progress(files: DataFrame, built: Graph) -> DataFrame:
    """One row ``(files, processed, skipped, nodes, edges)``: files with a known language are processed, others skipped."""
    known = F.col("language") != "unknown"
    f = files.select(extract.paths.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("files"), F.count_if(known).alias("processed"), F.count_if(~known).alias("skipped"))
    return f.crossJoin(built.nodes.agg(F.count("*").alias("nodes"))).crossJoin(built.edges.agg(F.count("*").alias("edges")))  # three tables of one row


def stored_path(path: str, root: str) -> str:
    """A path as it is stored: relative to the project if it lies in it, else as it is."""
    base = root.rstrip("/") + "/"
    return path[len(base) :] if path.startswith(base) else path


def live_path(stored: str, root: str) -> str:
    return stored if stored.startswith("/") else f"{root.rstrip('/')}/{stored}"
