"""Globs as column expressions: ``*`` and ``?`` match across folders too, ``[...]`` is a class, as fnmatch has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(glob: Column) -> Column:
    """The anchored regex of a glob; everything but ``*``, ``?`` and classes is literal."""
    quoted = F.regexp_replace(glob, r"([\\.^$+{}()|])", r"\\$1")
    classes = F.regexp_replace(quoted, r"\[!", "[^")
    single = F.replace(classes, F.lit("?"), F.lit("."))
    return F.concat(F.lit("^(?s:"), F.replace(single, F.lit("*"), F.lit(".*")), F.lit(")$"))


def matches(path: Column, glob: Column) -> Column:
    return F.regexp_like(path, to_regex(glob))


def matches_any(path: Column, globs: Column) -> Column:
    """Whether one of an array of globs matches; null and an empty array: none."""
    return F.coalesce(F.exists(globs, lambda g: F.coalesce(matches(path, g), F.lit(False))), F.lit(False))
