"""Vector columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for a null, an empty or a zero vector, for unlike lengths and where a NaN or an infinity leaves no number."""
    zero, d = F.lit(0.0), lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), zero, lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, zero, lambda s, x: s + d(x) * d(x)))
    size = norm(a) * norm(b)
    return F.nanvl(F.coalesce(F.when((F.size(a) == F.size(b)) & (size > 0), dot / size), zero), zero)


@F.pandas_udf(ArrayType(FloatType()))
def decode_vector(blob: pd.Series) -> pd.Series:
    """Little-endian float32 bytes as an array; a trailing partial group is dropped, null stays null."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4").tolist())


@F.pandas_udf(BinaryType())
def encode_vector(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
