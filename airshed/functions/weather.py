"""weather verdict (first matching rule wins; all bounds strict)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdict labels and their thresholds.
RAINY = "Rainy / Washed"
WINDY = "Windy & Clear"
COLD = "Cold & Stagnant"
HOT_DRY = "Hot & Dry"
HOT_HUMID = "Hot & Humid"
NORMAL = "Pleasant / Normal"


def weather_verdict(temp: Column, humidity: Column, wind: Column, rain: Column) -> Column:
    """Rules in order: rain > 2.0; wind > 15.0; temp < 18.0 and wind < 5.0;
    temp > 35.0 and humidity < 40.0; temp > 28.0 and humidity > 70.0; else
    normal.  A missing input makes its comparison unknown, so the row falls
    through to the next rule (NaN must be NULL already)."""
    return (F.when(rain > 2.0, RAINY)
            .when(wind > 15.0, WINDY)
            .when((temp < 18.0) & (wind < 5.0), COLD)
            .when((temp > 35.0) & (humidity < 40.0), HOT_DRY)
            .when((temp > 28.0) & (humidity > 70.0), HOT_HUMID)
            .otherwise(NORMAL))


def add_weather_verdict(df: DataFrame) -> DataFrame:
    return df.withColumn("weather_verdict", weather_verdict(
        F.col("temperature_2m"), F.col("relative_humidity_2m"),
        F.col("wind_speed_10m"), F.col("precipitation")))
