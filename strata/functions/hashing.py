"""Hashes that the JVM's functions don't have."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sha16(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def xxh64(text: Column | str) -> Column:
    """XXH64 with seed 0 of the text in UTF-8, 16 hex digits (the JVM's function has a seed of its own); null as empty."""

    def digest(texts: pd.Series) -> pd.Series:
        import xxhash

        return texts.map(lambda t: xxhash.xxh64_hexdigest((t or "").encode()))

    return F.pandas_udf(digest, "string")(text)
