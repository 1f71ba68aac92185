"""Hourly feeds derived from the driver's ``lineitem`` table.

The test data ships no air-quality table, so both hourly feeds are derived from
``lineitem`` with fixed arithmetic (the same text is used in the DuckDB oracle,
see :mod:`airshed.oracle`).  Every lineitem row becomes one hourly reading of
each feed; rows that a feed does not measure carry NULL in all its variables.
The days grow with ``l_orderkey`` (one more block of 360 days per 15,000
order keys), so every stage after the resample grows with the table too; the
timestamp range bounds ``l_orderkey`` near 4e9.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed.functions.nan import nan_to_null
from airshed.schemas import AQI_VARS, WEATHER_VARS
from airshed.sources.cities import dim_city

N_CITIES = 48

# Adapter arithmetic (shared with the SQL oracle).
TIME_EXPR = (
    "timestampadd(HOUR, cast(l_quantity as int) % 24, "
    "timestampadd(DAY, cast((l_orderkey % 12) * 30 + l_suppkey % 5 + 360 * (l_orderkey div 15000) as int), "
    "timestamp_ntz'2024-01-01 00:00:00'))"
)
AQI_MEASURED = "l_returnflag <> 'R'"
WEATHER_MEASURED = "l_returnflag <> 'A'"
AQI_EXPRS = {
    "pm10": "l_quantity * 4.0",
    "pm2_5": "case when l_linenumber = 7 then null else l_quantity * 2.0 + l_discount * 100 end",
}
WEATHER_EXPRS = {
    "temperature_2m": "8 + ix * 0.7e0 + l_discount * 20",
    "relative_humidity_2m": "20 + (l_orderkey % 12) * 7 + l_tax * 100",
    "wind_speed_10m": "(l_partkey % 6) * 3.2e0 + l_quantity / 50",
    "wind_direction_10m": "cast(cast(l_quantity * 7 as int) % 360 as double)",
    "precipitation": "case when l_linenumber <= 5 then null else l_tax * 25 end",
    "surface_pressure": "case when l_linenumber = 6 then null else 940 + l_quantity end",
}

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                 "l_quantity", "l_discount", "l_tax", "l_returnflag"]


def read_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _hourly(spark: SparkSession, lineitem: DataFrame, measured: str,
            exprs: dict[str, str], order: list[str]) -> DataFrame:
    dim = F.broadcast(dim_city(spark, with_index=True).select("ix", "city"))  # 48 fixed rows
    base = (lineitem.select(*LINEITEM_COLS)
            .withColumn("ix", F.expr(f"l_partkey % {N_CITIES}"))
            .join(dim, "ix"))
    cols = [F.expr(TIME_EXPR).alias("time"), F.col("city")]
    cols += [F.when(F.expr(measured), F.expr(exprs[c]).cast("double")).alias(c) for c in order]
    return base.select(*cols).transform(lambda d: nan_to_null(d, order))


def hourly_aqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly AQI feed (time, city, pm10, pm2_5)."""
    return _hourly(spark, read_lineitem(spark, sf_dir), AQI_MEASURED, AQI_EXPRS, AQI_VARS)


def hourly_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather feed (time, city, 6 variables)."""
    return _hourly(spark, read_lineitem(spark, sf_dir), WEATHER_MEASURED,
                   WEATHER_EXPRS, WEATHER_VARS)
