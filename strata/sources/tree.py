"""Source trees as a data source: one row a readable text file.

``spark.read.format("source_tree").load(root)`` walks ``root`` on the driver, as Spark's own listing
does, and packs files into partitions by size; executors read and decode them. Spark's file sources
cannot serve here, since they leave out names that start with ``_``, such as ``__init__.py``.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strata.functions.paths import SUFFIXES

SCHEMA = "file_path string, content string, size_bytes long"
#: fixed values: directories that are not walked; those that start with a dot are not either
SKIPPED = (
    "node_modules", "__pycache__", "venv", "dist", "build", "vendor", "coverage", "htmlcov", "target",
)
LARGEST = 1 << 20
PART_BYTES, PART_FILES = 64 << 20, 2000


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def decode(raw: bytes) -> str | None:
    """Text of a file, UTF-8 or else Latin-1; None for a binary one."""
    if b"\0" in raw[:8192]:
        return None
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.suffixes = tuple(s for s in options.get("suffixes", "").split(",") if s) or tuple(SUFFIXES)
        self.ignored = [p for p in options.get("ignore", "").split("\n") if p]
        self.largest = int(options.get("largest", LARGEST))

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.root if "://" in self.root else os.path.abspath(self.root))

    def _walk(self) -> Iterator[tuple[str, int]]:
        files, base = self._open()
        todo, seen = [base], set()
        while todo:
            folder = todo.pop()
            if files.type_name == "local":  # links may lead back
                real = os.path.realpath(folder)
                if real in seen:
                    continue
                seen.add(real)
            for info in sorted(files.get_file_info(pafs.FileSelector(folder)), key=lambda f: f.path):
                relative = info.path[len(base) :].lstrip("/")
                if any(fnmatch.fnmatch(relative, p) for p in self.ignored):
                    continue
                if info.type == pafs.FileType.Directory:
                    if info.base_name not in SKIPPED and not info.base_name.startswith("."):
                        todo.append(info.path)
                elif info.type == pafs.FileType.File and info.size <= self.largest and info.base_name.lower().endswith(self.suffixes):
                    yield relative, info.size

    def partitions(self) -> list[InputPartition]:
        out, now, size = [], [], 0
        for path, n in self._walk():
            if now and (size + n > PART_BYTES or len(now) == PART_FILES):
                out.append(_Files(now))
                now, size = [], 0
            now.append(path)
            size += n
        return [*out, _Files(now)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        files, base = self._open()
        for path in partition.paths:
            try:
                raw = files.open_input_stream(f"{base}/{path}").read()
            except FileNotFoundError:  # gone since it was listed
                continue
            text = decode(raw)
            if text is not None:
                yield path, text, len(raw)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> DataFrame:
    """``(file_path, content, size_bytes)`` of the text files under ``root``; ``ignore`` are globs on paths relative to it.

    Binary files, files over 1 MiB and unknown suffixes are left out; an empty tree gives an empty table.
    """
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("suffixes", ",".join(suffixes)).option("ignore", "\n".join(ignore)).load(root)
