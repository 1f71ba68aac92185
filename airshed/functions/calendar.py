"""Time parsing and calendar features (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_time(c: Column | str) -> Column:
    """Text -> TIMESTAMP_NTZ; accepts ``yyyy-MM-ddTHH:mm`` and
    ``yyyy-MM-dd HH:mm:ss``; anything unparsable becomes NULL (no job failure
    under ANSI mode)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("timestamp_ntz")


def time_of_day(hour: Column) -> Column:
    """[0,6) Midnight, [6,12) Morning, [12,18) Afternoon, otherwise Evening
    (a missing hour is Evening too)."""
    return (F.when((hour >= 0) & (hour < 6), "Midnight")
            .when((hour >= 6) & (hour < 12), "Morning")
            .when((hour >= 12) & (hour < 18), "Afternoon")
            .otherwise("Evening"))


def is_weekend(time: Column) -> Column:
    """1 on Saturday / Sunday (Monday = 0 numbering), else 0."""
    return F.coalesce(F.weekday(time).isin(5, 6), F.lit(False)).cast("int")


def add_time_features(df: DataFrame, time_col: str = "time") -> DataFrame:
    """Month, hour, day_of_week (English name), time_of_day, is_weekend."""
    t = F.col(time_col)
    hour = F.hour(t)
    return df.withColumns({
        "month": F.month(t),
        "hour": hour,
        "day_of_week": F.date_format(t, "EEEE"),
        "time_of_day": time_of_day(hour),
        "is_weekend": is_weekend(t),
    })
