"""6-hour tumbling aggregation of hourly city series.

Bins are left-closed, labelled by their start, aligned to local midnight.  The
``time`` column is ``TIMESTAMP_NTZ`` (local wall-clock time), so ``window()``
aligns to wall-clock midnight whatever the session time zone is.

Plan shape: the bin start is projected to a plain ``time`` column *before*
grouping, so the aggregate is hash-partitioned on ``(city, time)`` and the
later join on the same keys reuses that partitioning (no extra exchange).
Mean and sum are algebraic, so Spark pre-aggregates map-side (partial
HashAggregate); a hot city or hour is collapsed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airshed import schemas


def bin_start(time_col: str = "time", every: str = "6 hours"):
    """Start of the tumbling bin containing ``time_col``."""
    return F.window(time_col, every)["start"]


def resample(df: DataFrame, how: dict[str, str], every: str = "6 hours",
             key: str = "city", drop_incomplete: bool = True) -> DataFrame:
    """Per-key tumbling aggregate of value columns, then drop incomplete rows.

    ``how`` maps a column to ``"mean"`` or ``"sum"``.  A mean over no values is
    missing; a sum over no values is 0.0 (so such a row is kept).  Bins with no
    input rows are simply absent, which equals emitting them and dropping them.
    """
    cols = list(how)
    binned = df.select(bin_start("time", every).alias("time"), key, *cols)
    aggs = []
    for c in cols:
        kind = how[c]
        if kind == "mean":
            aggs.append(F.avg(c).alias(c))
        elif kind == "sum":
            aggs.append(F.coalesce(F.sum(c), F.lit(0.0)).alias(c))
        else:
            raise ValueError(f"unknown aggregation {kind!r} for {c}")
    out = binned.groupBy(key, "time").agg(*aggs).select("time", key, *cols)
    return drop_incomplete_rows(out) if drop_incomplete else out


def drop_incomplete_rows(df: DataFrame) -> DataFrame:
    """Keep rows where no column is missing (NULL or NaN)."""
    return df.dropna(how="any")


def resample_aqi(hourly: DataFrame) -> DataFrame:
    """A1: 6-hour mean of pm10 and pm2_5 per city."""
    return resample(hourly, schemas.AQI_AGG)


def resample_weather(hourly: DataFrame) -> DataFrame:
    """A2: 6-hour means of weather variables, precipitation summed."""
    return resample(hourly, schemas.WEATHER_AGG)
