import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airshed import schemas
from airshed.operators.resample import resample, resample_aqi, resample_weather
from tests.conftest import ts

AQI = "time timestamp_ntz, city string, pm10 double, pm2_5 double"
WEATHER = ("time timestamp_ntz, city string, temperature_2m double, relative_humidity_2m double, "
           "wind_speed_10m double, wind_direction_10m double, precipitation double, "
           "surface_pressure double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bin_is_local_wall_clock_in_any_session_zone(spark):
    df = spark.createDataFrame([(ts("2024-03-01 07:10:00"), "A", 1.0, 2.0)], AQI)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Kolkata", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r.time for r in resample_aqi(df).collect()] == [ts("2024-03-01 06:00:00")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_mean_skips_missing(spark):
    data = [(ts(f"2024-01-01 0{h}:00:00"), "A", None if h == 2 else float(h), 1.0) for h in range(6)]
    out = resample_aqi(spark.createDataFrame(data, AQI)).collect()
    assert len(out) == 1
    assert out[0].pm10 == (0 + 1 + 3 + 4 + 5) / 5


def test_left_closed_bins(spark):
    data = [(ts("2024-01-01 05:59:00"), "A", 1.0, 1.0), (ts("2024-01-01 06:00:00"), "A", 2.0, 2.0)]
    out = rows(resample_aqi(spark.createDataFrame(data, AQI)))
    assert [r[0] for r in out] == [ts("2024-01-01 00:00:00"), ts("2024-01-01 06:00:00")]


def test_no_rows_for_gap_days(spark):
    data = [(ts("2024-01-01 01:00:00"), "A", 1.0, 1.0), (ts("2024-01-03 01:00:00"), "A", 1.0, 1.0)]
    out = rows(resample_aqi(spark.createDataFrame(data, AQI)))
    assert [r[0].date() for r in out] == [dt.date(2024, 1, 1), dt.date(2024, 1, 3)]


def test_sum_of_nothing_is_zero_and_row_kept(spark):
    data = [(ts("2024-01-01 01:00:00"), "A", 20.0, 50.0, 3.0, 90.0, None, 1000.0),
            (ts("2024-01-01 02:00:00"), "A", 22.0, 60.0, 5.0, 90.0, None, 1002.0)]
    out = resample_weather(spark.createDataFrame(data, WEATHER)).collect()
    assert len(out) == 1 and out[0].precipitation == 0.0


def test_all_missing_mean_drops_row(spark):
    data = [(ts("2024-01-01 01:00:00"), "A", None, 1.0), (ts("2024-01-01 02:00:00"), "A", None, 2.0),
            (ts("2024-01-01 07:00:00"), "A", 3.0, 2.0)]
    out = rows(resample_aqi(spark.createDataFrame(data, AQI)))
    assert [r[0] for r in out] == [ts("2024-01-01 06:00:00")]


def test_wind_direction_mean_is_arithmetic(spark):
    data = [(ts("2024-01-01 01:00:00"), "A", 20.0, 50.0, 3.0, 350.0, 0.0, 1000.0),
            (ts("2024-01-01 02:00:00"), "A", 20.0, 50.0, 3.0, 10.0, 0.0, 1000.0)]
    out = resample_weather(spark.createDataFrame(data, WEATHER)).collect()
    assert out[0].wind_direction_10m == 180.0


def test_nan_in_source_is_null(spark):
    from airshed.functions.nan import nan_to_null
    df = spark.createDataFrame([(ts("2024-01-01 01:00:00"), "A", float("nan"), 1.0),
                                (ts("2024-01-01 02:00:00"), "A", 4.0, 1.0)], AQI)
    df = nan_to_null(df, schemas.AQI_VARS)
    assert df.where(F.col("pm10").isNull()).count() == 1
    assert resample_aqi(df).collect()[0].pm10 == 4.0


def test_output_columns_and_types(spark):
    df = spark.createDataFrame([(ts("2024-01-01 01:00:00"), "A", 1.0, 1.0)], AQI)
    assert resample_aqi(df).schema == schemas.RAW_AQI or \
        [f.name for f in resample_aqi(df).schema] == [f.name for f in schemas.RAW_AQI]
    assert resample_aqi(df).schema["time"].dataType.typeName() == "timestamp_ntz"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 71), st.sampled_from(["A", "B"]),
                          st.floats(0, 500, allow_nan=False)), min_size=1, max_size=40),
       st.randoms())
def test_resample_ignores_row_order(spark, data, rnd):
    base = dt.datetime(2024, 1, 1)
    recs = [(base + dt.timedelta(hours=h), c, v, v / 2) for h, c, v in data]
    shuffled = list(recs)
    rnd.shuffle(shuffled)
    a = rows(resample(spark.createDataFrame(recs, AQI), schemas.AQI_AGG))
    b = rows(resample(spark.createDataFrame(shuffled, AQI).repartition(3), schemas.AQI_AGG))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:2] == y[:2]
        assert all(math.isclose(p, q, rel_tol=1e-12, abs_tol=1e-12) for p, q in zip(x[2:], y[2:]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 95), st.sampled_from(["A", "B"]),
                          st.one_of(st.none(), st.floats(0, 50, allow_nan=False)),
                          st.one_of(st.none(), st.floats(0, 5, allow_nan=False))),
                min_size=1, max_size=60, unique_by=lambda r: (r[0], r[1])))
def test_resample_equals_pandas_semantics(spark, data):
    """Per city: pandas resample('6h') with mean / sum, then dropna()."""
    import pandas as pd
    base = dt.datetime(2024, 3, 1)
    recs = [(base + dt.timedelta(hours=h), c, t, p) for h, c, t, p in data]
    schema = "time timestamp_ntz, city string, temperature_2m double, precipitation double"
    ours = resample(spark.createDataFrame(recs, schema),
                    {"temperature_2m": "mean", "precipitation": "sum"})
    got = sorted((r.time, r.city, round(r.temperature_2m, 9), round(r.precipitation, 9))
                 for r in ours.collect())
    pdf = pd.DataFrame(recs, columns=["time", "city", "temperature_2m", "precipitation"])
    want = []
    for city, g in pdf.groupby("city"):
        out = (g.drop(columns="city").set_index("time").astype(float)
               .resample("6h").agg({"temperature_2m": "mean", "precipitation": "sum"})
               .reset_index().dropna())
        want += [(r.time.to_pydatetime(), city, round(r.temperature_2m, 9), round(r.precipitation, 9))
                 for r in out.itertuples()]
    assert got == sorted(want)
