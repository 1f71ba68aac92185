"""Combine the two 6-hour feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from airshed.schemas import AQI_VARS, WEATHER_VARS

KEYS = ["city", "time"]


def merge_feeds(aqi: DataFrame, weather: DataFrame) -> DataFrame:
    """Inner equi-join on (city, time); keys once, AQI columns first.

    Both inputs come out of :func:`resample` hash-partitioned on (city, time),
    so the sort-merge join needs no further exchange.  There each side is
    unique on (city, time), so every key yields at most one row.  A direct
    caller with repeated keys gets the original merge's many-to-many rows;
    AQE's skew-join handling splits a hot key.  NULL keys never match, which
    equals the original job because its keys cannot be missing after the
    drop of incomplete rows.
    """
    w_cols = [c for c in weather.columns if c not in KEYS]
    a_cols = [c for c in aqi.columns if c not in KEYS]
    joined = aqi.join(weather, KEYS, "inner")
    return joined.select("time", "city", *a_cols, *w_cols)


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """Union-all by column name of per-city (or per-source) frames."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b), frames)


MERGED_ORDER = ["time", "city", *AQI_VARS, *WEATHER_VARS]
