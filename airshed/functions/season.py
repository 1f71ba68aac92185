"""season by region and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Per region group, (months, season) checked in order; the last
# season applies to every other month (a missing month included).
SEASONS = [
    (["South"], [
        ([1, 2], "Winter"),
        ([3, 4, 5], "Summer"),
        ([6, 7, 8, 9], "Southwest Monsoon"),
    ], "Retreating Monsoon"),
    (["Northeast"], [
        ([12, 1, 2], "Winter"),
        ([3, 4], "Pre-Monsoon"),
        ([5, 6, 7, 8, 9, 10], "Extended Monsoon"),
    ], "Post-Monsoon"),
    (["North", "Central", "East", "West", "NCR"], [
        ([12, 1, 2], "Winter"),
        ([3, 4, 5, 6], "Summer"),
        ([7, 8, 9], "Southwest Monsoon"),
    ], "Post-Monsoon"),
    (["UT"], [
        ([12, 1, 2], "Winter"),
        ([3, 4], "Spring"),
        ([5, 6, 7, 8], "Summer"),
    ], "Autumn"),
]
UNKNOWN = "Unknown"


def regional_season(region: Column, month: Column) -> Column:
    out = None
    for regions, rules, last in SEASONS:
        inner = None
        for months, name in rules:
            cond = month.isin(*months)
            inner = F.when(cond, name) if inner is None else inner.when(cond, name)
        inner = inner.otherwise(last)
        cond = region.isin(*regions)
        out = F.when(cond, inner) if out is None else out.when(cond, inner)
    return out.otherwise(UNKNOWN)


def add_regional_season(df: DataFrame) -> DataFrame:
    return df.withColumn("regional_season", regional_season(F.col("region"), F.col("month")))
