"""Decisions, contracts and intents kept as YAML files: one record a file, read and written by executors.

An empty, malformed or non-mapping file gives no record. PyYAML is needed by these functions alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.tree import read_tree

DECISION = (
    "id string, title string, status string, context string, decision string, consequences array<string>, supersedes string, superseded_by string, author string, created_at timestamp, review_by timestamp, tags array<string>, "
    "code_anchors array<struct<file_path:string,line_start:int,line_end:int,symbol_name:string,content_hash:string>>, constraints array<struct<description:string,source:string,is_hard:boolean,expiry_date:timestamp>>, "
    "alternatives array<struct<name:string,description:string,rejection_reason:string>>"
)
CONTRACT = (
    "id string, name string, description string, priority int, scope struct<include_patterns:array<string>,exclude_patterns:array<string>,languages:array<string>,exclude_tests:boolean,exclude_generated:boolean>, "
    "rules array<struct<id:string,name:string,description:string,kind:string,severity:string,pattern:string,anti_pattern:string,threshold_metric:string,threshold_value:double,fix_suggestion:string,migration_deadline:timestamp>>"
)
INTENT = "id string, title string, description string, status string, created_at timestamp, criteria array<struct<description:string,check_type:string,check_value:string,satisfied:boolean>>"


def anchor(short: str) -> dict:
    """``path``, ``path:n`` or ``path:n-m``; what follows the last colon and is no line number belongs to the path."""
    path, colon, at = short.rpartition(":")
    m = re.fullmatch(r"([0-9]+)(?:-([0-9]+))?", at) if colon else None
    return {"file_path": path, "line_start": int(m[1]), "line_end": int(m[2] or m[1])} if m else {"file_path": short}


def _decision(record: dict) -> dict:
    anchors = []
    for a in record.get("code_anchors") or []:
        if isinstance(a, str):
            anchors.append(anchor(a))
        elif isinstance(a, dict):
            lines = a.get("line_range") or {}
            anchors.append({"line_start": lines.get("start"), "line_end": lines.get("end")} | {k: v for k, v in a.items() if k != "line_range"})
    rules = [{"description": c, "source": "unknown", "is_hard": True} if isinstance(c, str) else c for c in record.get("constraints") or []]
    return record | {"code_anchors": anchors, "constraints": rules}


#: fixed values: what kinds, severities and statuses a record may name
RULE_KINDS = ("pattern", "threshold", "architectural", "ai_antipattern")
SEVERITIES = ("error", "warning", "info")
CHECKS = ("file_exists", "file_contains", "function_exists", "wired", "cli_works", "mcp_tool_exists", "test_passes", "grep_match", "grep_no_match", "custom", "manual")
INTENT_STATUSES = ("draft", "active", "verified", "partial", "failed", "archived")


def one_of(value, allowed: tuple[str, ...], default: str) -> str:
    """``value`` in lower case if it is allowed, else the default."""
    named = str(value).strip().lower().replace("-", "_") if value is not None else default
    return named if named in allowed else default


def _contract(record: dict) -> dict:
    rules = [r | {"kind": one_of(r.get("kind"), RULE_KINDS, "pattern"), "severity": one_of(r.get("severity"), SEVERITIES, "warning")} for r in record.get("rules") or [] if isinstance(r, dict)]
    return record | {"rules": rules, "scope": record.get("scope") or {}, "priority": record.get("priority", 100)}


def _intent(record: dict) -> dict:
    """Criteria may be given by ``type`` and ``check`` for short, and as plain text for one that needs a person."""
    criteria = []
    for c in record.get("criteria") or record.get("acceptance_criteria") or []:
        c = {"description": c} if isinstance(c, str) else c
        criteria.append(c | {"check_type": one_of(c.get("check_type", c.get("type")), CHECKS, "manual"), "check_value": c.get("check_value", c.get("check")), "satisfied": bool(c.get("satisfied", False))})
    return record | {"criteria": criteria, "status": one_of(record.get("status"), INTENT_STATUSES, "active")}


def _read(spark: SparkSession, root: str, schema: str, shaped) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for b in batches:
            paths, out = [], []
            for path, text in zip(b.column("file_path").to_pylist(), b.column("content").to_pylist()):
                try:
                    record = yaml.safe_load(text)
                except yaml.YAMLError:
                    continue
                if isinstance(record, dict):
                    paths.append(path)
                    out.append(json.dumps(shaped(record), default=str))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(out, pa.string())], ["file_path", "j"])

    rows = read_tree(spark, root, suffixes=(".yaml", ".yml")).select("file_path", "content").mapInArrow(run, "file_path string, j string")
    return rows.select("file_path", F.from_json("j", schema).alias("r")).select("file_path", "r.*")


def read_decisions(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, DECISION, _decision)


def read_contracts(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, CONTRACT, _contract)


def read_intents(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, INTENT, _intent)


def write_records(rows: DataFrame, root: str, key: str = "id") -> None:
    """One YAML file a row, named by ``key`` (characters other than letters, digits, ``.``, ``_`` and ``-`` become ``_``).

    A file is written beside its place and then moved there, so that a repeated task leaves whole files. Nulls are left out.
    """

    def put(part) -> None:
        import uuid

        import yaml

        files, base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        files.create_dir(base)
        for j, name in part:
            at = f"{base}/{re.sub(r'[^A-Za-z0-9._-]', '_', name)}.yaml"
            temporary = f"{base}/.{uuid.uuid4().hex}"
            with files.open_output_stream(temporary) as f:
                f.write(yaml.safe_dump(json.loads(j), sort_keys=False, allow_unicode=True).encode())
            files.move(temporary, at)

    rows.filter(F.col(key).isNotNull()).select(F.to_json(F.struct("*")), F.col(key).cast("string")).foreachPartition(put)
