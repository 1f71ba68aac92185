"""NaN handling: the job treats NaN as missing, i.e. SQL NULL.

Spark orders NaN above every number (``NaN > 2.0`` is true) and ``avg`` over a
NaN is NaN, whereas the job's rules treat NaN as "no value".  Every source
therefore turns NaN into NULL before any comparison or aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_if_nan(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c, F.lit(None).cast("double"))


def nan_to_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    cols = list(cols)
    return df.withColumns({c: null_if_nan(c) for c in cols})
