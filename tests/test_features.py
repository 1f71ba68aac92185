import math

import pytest
from pyspark.sql import functions as F

from airshed.functions.calendar import add_time_features
from airshed.functions.model_features import build_features
from airshed.functions.season import regional_season
from airshed.functions.weather import weather_verdict
from airshed.operators.merge import merge_feeds
from airshed.operators.region import RegionMappingError, add_region
from airshed.sources.cities import CITIES, dim_city
from tests.conftest import ts


def verdict(spark, rain, wind, temp, hum):
    df = spark.createDataFrame([(temp, hum, wind, rain)], "t double, h double, w double, r double")
    return df.select(weather_verdict(F.col("t"), F.col("h"), F.col("w"), F.col("r")).alias("v")).first().v


@pytest.mark.parametrize("rain,wind,temp,hum,expected", [
    (2.0, 1.0, 25.0, 50.0, "Pleasant / Normal"),
    (2.01, 1.0, 25.0, 50.0, "Rainy / Washed"),
    (3.0, 20.0, 25.0, 50.0, "Rainy / Washed"),
    (0.0, 15.0, 25.0, 50.0, "Pleasant / Normal"),
    (0.0, 15.1, 25.0, 50.0, "Windy & Clear"),
    (0.0, 4.9, 17.9, 50.0, "Cold & Stagnant"),
    (0.0, 4.9, 18.0, 50.0, "Pleasant / Normal"),
    (0.0, 6.0, 35.1, 39.9, "Hot & Dry"),
    (0.0, 6.0, 28.1, 70.1, "Hot & Humid"),
    (None, 6.0, 25.0, 50.0, "Pleasant / Normal"),
])
def test_weather_verdict(spark, rain, wind, temp, hum, expected):
    assert verdict(spark, rain, wind, temp, hum) == expected


def test_verdict_nan_rain_after_normalisation(spark):
    from airshed.functions.nan import null_if_nan
    df = spark.createDataFrame([(25.0, 50.0, 6.0, float("nan"))], "t double, h double, w double, r double")
    v = df.select(weather_verdict(F.col("t"), F.col("h"), F.col("w"), null_if_nan("r")).alias("v")).first().v
    assert v == "Pleasant / Normal"


def test_time_of_day_and_weekend(spark):
    hours = [0, 5, 6, 11, 12, 17, 18, 23]
    df = spark.createDataFrame([(ts(f"2024-01-05 {h:02d}:00:00"),) for h in hours], "time timestamp_ntz")
    got = [r.time_of_day for r in add_time_features(df).orderBy("time").collect()]
    assert got == ["Midnight"] * 2 + ["Morning"] * 2 + ["Afternoon"] * 2 + ["Evening"] * 2
    from airshed.functions.calendar import time_of_day
    null_hour = spark.range(1).select(time_of_day(F.lit(None).cast("int")).alias("x")).first().x
    assert null_hour == "Evening"
    days = ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08"]  # Fri Sat Sun Mon
    df = spark.createDataFrame([(ts(d + " 00:00:00"),) for d in days], "time timestamp_ntz")
    out = add_time_features(df).orderBy("time").collect()
    assert [r.is_weekend for r in out] == [0, 1, 1, 0]
    assert [r.day_of_week for r in out] == ["Friday", "Saturday", "Sunday", "Monday"]


EXPECTED_SEASON = {
    "South": ["Winter"] * 2 + ["Summer"] * 3 + ["Southwest Monsoon"] * 4 + ["Retreating Monsoon"] * 3,
    "Northeast": ["Winter"] * 2 + ["Pre-Monsoon"] * 2 + ["Extended Monsoon"] * 6 + ["Post-Monsoon", "Winter"],
    "UT": ["Winter"] * 2 + ["Spring"] * 2 + ["Summer"] * 4 + ["Autumn"] * 3 + ["Winter"],
}
for _r in ["North", "Central", "East", "West", "NCR"]:
    EXPECTED_SEASON[_r] = (["Winter"] * 2 + ["Summer"] * 4 + ["Southwest Monsoon"] * 3
                           + ["Post-Monsoon"] * 2 + ["Winter"])


def test_season_table_all_96(spark):
    data = [(r, m) for r in EXPECTED_SEASON for m in range(1, 13)]
    df = spark.createDataFrame(data, "region string, month int")
    got = {(r.region, r.month): r.s for r in
           df.select("region", "month", regional_season(F.col("region"), F.col("month")).alias("s")).collect()}
    assert len(got) == 96
    for r, seasons in EXPECTED_SEASON.items():
        assert [got[(r, m)] for m in range(1, 13)] == seasons
    other = spark.createDataFrame([("Mars", 1)], "region string, month int")
    assert other.select(regional_season(F.col("region"), F.col("month"))).first()[0] == "Unknown"


def test_region_check_is_eager_and_names_city(spark):
    df = spark.createDataFrame([("Atlantis", 1.0), ("Delhi", 2.0)], "city string, x double")
    with pytest.raises(RegionMappingError, match="Atlantis"):
        add_region(df, dim_city(spark)).select("x")  # region not even selected


def test_region_lookup(spark):
    df = spark.createDataFrame([("Leh",), ("Delhi",)], "city string")
    got = {r.city: r.region for r in add_region(df, dim_city(spark)).collect()}
    assert got == {"Leh": "UT", "Delhi": "NCR"}
    assert len(CITIES) == 48
    counts = {}
    for *_x, r in CITIES:
        counts[r] = counts.get(r, 0) + 1
    assert counts == {"North": 7, "NCR": 6, "West": 7, "South": 8, "Central": 4,
                      "East": 6, "Northeast": 9, "UT": 1}


def test_merge_many_to_many_and_one_sided(spark):
    a = spark.createDataFrame([(ts("2024-01-01 00:00:00"), "A", 1.0, 1.0),
                               (ts("2024-01-01 00:00:00"), "A", 2.0, 2.0),
                               (ts("2024-01-01 06:00:00"), "B", 1.0, 1.0)],
                              "time timestamp_ntz, city string, pm10 double, pm2_5 double")
    w = spark.createDataFrame([(ts("2024-01-01 00:00:00"), "A", 9.0)],
                              "time timestamp_ntz, city string, temperature_2m double")
    out = merge_feeds(a, w)
    assert out.columns == ["time", "city", "pm10", "pm2_5", "temperature_2m"]
    assert out.count() == 2


def _engineered_row(spark, **over):
    base = dict(time=ts("2024-01-01 06:00:00"), city="Delhi", pm10=1.0, pm2_5=2.0,
                temperature_2m=20.0, relative_humidity_2m=50.0, wind_speed_10m=3.0,
                wind_direction_10m=90.0, precipitation=0.5, surface_pressure=1000.0,
                month=12, hour=6, day_of_week="Monday", time_of_day="Morning", is_weekend=0,
                weather_verdict="Pleasant / Normal", region="NCR", regional_season="Winter")
    base.update(over)
    from airshed.schemas import ENGINEERED
    return spark.createDataFrame([tuple(base[f.name] for f in ENGINEERED)], ENGINEERED)


def test_crosses_missing_season_is_nan(spark):
    out = build_features(_engineered_row(spark, regional_season=None)).first()
    assert out.season_region == "nan_NCR" and out.season_city == "nan_Delhi"


def test_cyclic_and_wind(spark):
    out = build_features(_engineered_row(spark)).first()
    assert (round(out.dow_sin, 6), round(out.dow_cos, 6)) == (0.0, 1.0)
    assert (round(out.month_sin, 6) + 0.0, round(out.month_cos, 6)) == (0.0, 1.0)
    assert (round(out.hour_sin, 6), round(out.hour_cos, 6) + 0.0) == (1.0, 0.0)
    for deg, (s, c) in {0: (0, 1), 90: (1, 0), 180: (0, -1), 270: (-1, 0)}.items():
        o = build_features(_engineered_row(spark, wind_direction_10m=float(deg))).first()
        assert (round(o.wind_dir_sin, 6) + 0.0, round(o.wind_dir_cos, 6) + 0.0) == (s, c)
    for r in build_features(_engineered_row(spark)).collect():
        assert math.isclose(r.wind_dir_sin ** 2 + r.wind_dir_cos ** 2, 1.0)


def test_feature_matrix_columns_and_target(spark):
    from airshed.schemas import FEATURES
    df = _engineered_row(spark)
    out = build_features(df, target="pm10", keep=())
    assert out.columns == FEATURES + ["label"]
    assert len(FEATURES) == 22
    assert out.first().label == 1.0


def test_categorical_codes_sorted(spark):
    from airshed.plans.train import categorical_indexer
    df = spark.createDataFrame([(c, "x", "y", "z", "w") for c in ["b", "a", "c"]],
                               "city string, weather_verdict string, time_of_day string, "
                               "season_region string, season_city string")
    idx = categorical_indexer().fit(df)
    assert {r.city: int(r.city_code) for r in idx.transform(df).collect()} == {"a": 0, "b": 1, "c": 2}
    unseen = spark.createDataFrame([("zz", "x", "y", "z", "w")], df.schema)
    assert int(idx.transform(unseen).first().city_code) == 3  # extra bucket
