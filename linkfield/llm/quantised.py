"""Vectors of whole numbers: what the operators share that count in integers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Components lie within this after scaling, so sums of their squares and products stay exact.
LIMIT = 1 << 22


def quantised(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = 256) -> DataFrame:
    """vec_id, label, q: floor(scale * x) of each component, held to +-LIMIT.  Rows go whose vector is null or holds
    null or non-finite components; other columns go, too."""
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vec_col}`").cast(ArrayType(DoubleType())).alias("v"))
    held = lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x * scale))).cast("int")
    return rows.where(v.isNotNull() & ~odd).select("vec_id", "label", F.transform(v, held).alias("q"))


def of_one_length(rows: DataFrame, multiple: int = 1) -> tuple[DataFrame, int]:
    """rows whose vectors all have the longest one's length, rounded up to a multiple (zeros follow shorter ones), and
    that length."""
    least, most = rows.agg(F.min(F.size("q")), F.max(F.size("q"))).first()
    length = max(1, math.ceil((most or 0) / multiple)) * multiple
    if least == length:
        return rows, length
    return rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0), F.lit(length) - F.size("q")))), length


def matrix(column) -> np.ndarray:
    """A column of equally long lists as an array of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)
