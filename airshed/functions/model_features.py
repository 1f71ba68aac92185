"""The model feature matrix, one projection.

All expressions are built-in (whole-stage codegen); Catalyst collapses the
chain of ``withColumns`` into a single Project.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airshed.schemas import FEATURES

# English day names -> Monday-based ordinal.
DAY_ORDINAL = {
    "Monday": 0, "Tuesday": 1, "Wednesday": 2, "Thursday": 3,
    "Friday": 4, "Saturday": 5, "Sunday": 6,
}

TWO_PI = 2 * math.pi


def text_or_nan(c: Column) -> Column:
    """Missing values render as the text ``nan`` when glued into a string."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def cross(a: str, b: str) -> Column:
    """``<a>_<b>`` string cross of two categorical columns."""
    return F.concat(text_or_nan(F.col(a)), F.lit("_"), text_or_nan(F.col(b)))


def day_ordinal(day_name: Column) -> Column:
    """Day name -> 0..6 through a literal map; unknown names -> NULL."""
    m = F.create_map(*[x for k, v in DAY_ORDINAL.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, day_name)


def cyc_sin(x: Column, period: int) -> Column:
    return F.sin(F.lit(TWO_PI) * x / F.lit(period))


def cyc_cos(x: Column, period: int) -> Column:
    return F.cos(F.lit(TWO_PI) * x / F.lit(period))


def build_features(df: DataFrame, target: str = "pm2_5", keep: tuple[str, ...] = ("time",),
                   label: str = "label") -> DataFrame:
    """Engineered table -> (keep..., 22 feature columns, label).

    ``target`` is a parameter; both pollutants leave the features whatever the
    target.  ``keep`` carries key columns (the split hashes on city and time).
    """
    dow = day_ordinal(F.col("day_of_week"))
    wd = F.radians(F.col("wind_direction_10m"))
    exprs = {
        "season_region": cross("regional_season", "region"),
        "season_city": cross("regional_season", "city"),
        "temp_humidity": F.col("temperature_2m") * F.col("relative_humidity_2m"),
        "wind_precip": F.col("wind_speed_10m") * F.col("precipitation"),
        "pressure_temp": F.col("surface_pressure") * F.col("temperature_2m"),
        "wind_dir_sin": F.sin(wd),
        "wind_dir_cos": F.cos(wd),
        "dow_sin": cyc_sin(dow, 7),
        "dow_cos": cyc_cos(dow, 7),
        "month_sin": cyc_sin(F.col("month"), 12),
        "month_cos": cyc_cos(F.col("month"), 12),
        "hour_sin": cyc_sin(F.col("hour"), 24),
        "hour_cos": cyc_cos(F.col("hour"), 24),
    }
    out = df.withColumns(exprs)
    cols = [*keep, *FEATURES]
    return out.select(*cols, F.col(target).cast("double").alias(label))
