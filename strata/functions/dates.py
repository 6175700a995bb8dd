"""Times in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_utc(text: Column) -> Column:
    """An ISO time as a timestamp: one without a zone is UTC, whatever the session's zone is; what is none is null."""
    zoned = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})\s*$")
    plain = F.when(text.rlike(r"[T ][0-9]{1,2}:"), F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("T00:00:00Z")))
    return F.try_to_timestamp(F.when(zoned, text).otherwise(plain))
