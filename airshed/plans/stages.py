"""W1-W4 as DataFrame -> DataFrame stage functions.

A stage function never reads or writes; :mod:`airshed.plans.jobs` wraps them
with sources and sinks.  Chained, they form one lazy plan from the hourly
scans to the engineered table; the only eager point is the region check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from airshed.functions.calendar import add_time_features
from airshed.functions.season import add_regional_season
from airshed.functions.weather import add_weather_verdict
from airshed.operators.merge import merge_feeds
from airshed.operators.region import add_region
from airshed.operators.resample import resample_aqi, resample_weather


def gather_aqi(hourly: DataFrame) -> DataFrame:
    """W1 core: hourly AQI rows -> raw_aqi (6-hour means, complete rows)."""
    return resample_aqi(hourly)


def gather_weather(hourly: DataFrame) -> DataFrame:
    """W2 core: hourly weather rows -> raw_weather."""
    return resample_weather(hourly)


def merge(aqi: DataFrame, weather: DataFrame) -> DataFrame:
    """raw_aqi x raw_weather -> merged."""
    return merge_feeds(aqi, weather)


def engineer(merged: DataFrame, dim: DataFrame, check_regions: bool = True) -> DataFrame:
    """Merged -> engineered (calendar, verdict, region, season)."""
    return (merged
            .transform(add_time_features)
            .transform(add_weather_verdict)
            .transform(lambda d: add_region(d, dim, check=check_regions))
            .transform(add_regional_season))
