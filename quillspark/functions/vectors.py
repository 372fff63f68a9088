"""Vector arithmetic over array columns, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 where a vector is empty or has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    norms = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(n.isNull() | (n == 0) | (norms == 0), 0.0).otherwise(dot(x, y) / norms)


def sigmoid(x: Column) -> Column:
    """The logistic function without overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def pack(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")

    return run(vector)


def unpack(raw: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: np.frombuffer(b, "<f4"), na_action="ignore")

    return run(raw)
