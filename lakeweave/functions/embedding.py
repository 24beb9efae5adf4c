"""A deterministic embedding of texts, for tests and as an example of a pluggable one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def hash_vectors(texts: pd.Series, dimension: int = 64) -> list[list[float]]:
    """Unit vectors of sines, seeded by each text's hash."""
    seed = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "little") for t in texts], float)
    v = np.sin(seed[:, None] * 1e-3 + np.arange(1, dimension + 1) * 12.9898)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).tolist()


def embed(df: DataFrame, text: str, fn: Callable[[pd.Series], list[list[float]]] = hash_vectors, into: str = "embedding") -> DataFrame:
    """`df` with the vectors of its texts; each distinct text is embedded once."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(fn(t))

    distinct = df.select(text).where(F.col(text).isNotNull()).distinct()
    return df.join(distinct.withColumn(into, run(text)), text, "left")
