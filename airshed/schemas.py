"""Fixed schemas of every stage table (no schema inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

D = T.DoubleType()
S = T.StringType()
NTZ = T.TimestampNTZType()
I = T.IntegerType()

# Variable names of the payloads.
AQI_VARS = ["pm10", "pm2_5"]
WEATHER_VARS = [
    "temperature_2m", "relative_humidity_2m", "wind_speed_10m",
    "wind_direction_10m", "precipitation", "surface_pressure",
]

# 6-hour aggregation per variable: everything is a mean except rain, a sum.
AQI_AGG = {c: "mean" for c in AQI_VARS}
WEATHER_AGG = {c: ("sum" if c == "precipitation" else "mean") for c in WEATHER_VARS}

DIM_CITY = T.StructType([
    T.StructField("city", S, False),
    T.StructField("lat", D, False),
    T.StructField("lon", D, False),
    T.StructField("region", S, False),
])

RAW_AQI = T.StructType(
    [T.StructField("time", NTZ), T.StructField("city", S)]
    + [T.StructField(c, D) for c in AQI_VARS])

RAW_WEATHER = T.StructType(
    [T.StructField("time", NTZ), T.StructField("city", S)]
    + [T.StructField(c, D) for c in WEATHER_VARS])

MERGED = T.StructType(list(RAW_AQI.fields) + [T.StructField(c, D) for c in WEATHER_VARS])

ENGINEERED = T.StructType(list(MERGED.fields) + [
    T.StructField("month", I),
    T.StructField("hour", I),
    T.StructField("day_of_week", S),
    T.StructField("time_of_day", S),
    T.StructField("is_weekend", I),
    T.StructField("weather_verdict", S),
    T.StructField("region", S),
    T.StructField("regional_season", S),
])

# Model input columns, in order.
FEATURES = [
    "city", "temperature_2m", "relative_humidity_2m", "wind_speed_10m",
    "precipitation", "surface_pressure", "time_of_day", "is_weekend",
    "weather_verdict", "season_region", "season_city", "temp_humidity",
    "wind_precip", "pressure_temp", "wind_dir_sin", "wind_dir_cos",
    "dow_sin", "dow_cos", "month_sin", "month_cos", "hour_sin", "hour_cos",
]
# The categorical ones.
CATEGORICAL = ["city", "weather_verdict", "time_of_day", "season_region", "season_city"]
NUMERIC = [c for c in FEATURES if c not in CATEGORICAL]


def payload_schema(variables: list[str]) -> T.StructType:
    """Landed JSON payload: ``{"hourly": {"time": [...], var: [...], ...}}``."""
    hourly = T.StructType(
        [T.StructField("time", T.ArrayType(S))]
        + [T.StructField(v, T.ArrayType(D)) for v in variables])
    return T.StructType([
        T.StructField("hourly", hourly),
        T.StructField("_corrupt_record", S),
    ])


REJECTS = T.StructType([
    T.StructField("feed", S, False),
    T.StructField("city", S),
    T.StructField("reason", S, False),
])

FOLD_RESULTS = T.StructType([
    T.StructField("Fold", I, False),
    T.StructField("Train_R2", D),
    T.StructField("CV_R2", D),
    T.StructField("Gap", D),
])
