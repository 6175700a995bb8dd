"""Every query of the engine by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.plans import answers, engine, extraction, graphs, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(graphs.QUERIES) | extraction.QUERIES | streams.QUERIES | engine.QUERIES
ORACLE_SQL: dict[str, str] = {k: graphs.duck(v) for k, v in graphs.ORACLES.items()} | extraction.ORACLES | streams.ORACLES | answers.ORACLES
