"""Helpers for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding, dims)`` of rows with an id and a vector that is not null, not zero, without null or non-finite components."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long"), "embedding", F.size("embedding").alias("dims"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of one length as a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(a), -1) if len(a) else flat.reshape(0, 0)
