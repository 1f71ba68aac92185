"""Presentation helpers for results that are compared across engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (floating-point sum order is not fixed, so
    unrounded doubles are never hashed)."""
    return df.withColumns({
        f.name: F.round(F.col(f.name), digits)
        for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    })
