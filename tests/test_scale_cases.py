"""Skew, property and model sanity cases."""

import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airshed import catalog
from airshed.operators.split import assign_folds
from airshed.plans.stages import gather_aqi
from airshed.sources.adapter import hourly_aqi
from tests.conftest import SF001

SF01 = "/root/testdata/sf0.01"


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(min_value=5, max_value=400), st.integers(min_value=2, max_value=7))
def test_fold_sizes_differ_by_at_most_one(spark, n, k):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(base + dt.timedelta(hours=i), "A") for i in range(n)],
                               "time timestamp_ntz, city string")
    sizes = [r["count"] for r in assign_folds(df, k, 1).groupBy("fold").count().orderBy("fold").collect()]
    assert sum(sizes) == n and len(sizes) == min(k, n)
    assert max(sizes) - min(sizes) <= 1
    assert sizes == sorted(sizes, reverse=True)  # larger folds first


def test_hot_city_resample_matches_brute_force(spark):
    """A third of all hourly rows moved onto one city: same bins as DuckDB."""
    import duckdb
    hourly = hourly_aqi(spark, SF01)
    skewed = hourly.withColumn(
        "city", F.when(F.abs(F.hash("time", "pm10")) % 3 == 0, F.lit("Delhi")).otherwise(F.col("city")))
    share = skewed.where(F.col("city") == "Delhi").count() / skewed.count()
    assert share > 0.3
    out = gather_aqi(skewed)
    got = sorted((r.time, r.city, round(r.pm10, 6), round(r.pm2_5, 6)) for r in out.collect())
    pdf = skewed.toPandas()
    con = duckdb.connect()
    con.register("h", pdf)
    want = con.execute(
        "SELECT time_bucket(INTERVAL 6 HOUR, time) AS t, city, round(avg(pm10), 6), round(avg(pm2_5), 6) "
        "FROM h GROUP BY 1, 2 HAVING avg(pm10) IS NOT NULL AND avg(pm2_5) IS NOT NULL").fetchall()
    want = sorted((t.to_pydatetime() if hasattr(t, "to_pydatetime") else t, c, a, b) for t, c, a, b in want)
    assert got == want


def test_gbt_learns_signal(spark):
    from airshed.operators.crossval import r2_by
    from airshed.operators.trees import importance, predict
    from airshed.schemas import FEATURES
    nodes, _, test_rows = catalog._boosted(spark, SF001, trees=5)
    r2 = r2_by(predict(test_rows, nodes).withColumn("g", F.lit(1)), ["g"]).first().r2
    assert r2 > 0.0
    imp = importance(nodes, FEATURES).collect()
    assert len(imp) == 22 and imp[0].importance > 0 and all(r.importance >= 0 for r in imp)
    assert os.path.isdir(spark.sparkContext.getCheckpointDir().replace("file:", ""))


def test_categorical_metadata_reaches_trees(spark):
    from airshed.params import TrainParams
    from airshed.plans.train import assembler, prepare
    _, coded = prepare(catalog.engineered(spark, SF001), TrainParams())
    assembled = assembler().transform(coded)
    attrs = assembled.schema["features"].metadata["ml_attr"]["attrs"]
    nominal = {a["name"]: len(a.get("vals", [])) for a in attrs.get("nominal", [])}
    assert set(nominal) == {"city_code", "weather_verdict_code", "time_of_day_code",
                            "season_region_code", "season_city_code"}
    from airshed.plans.train import bins_for
    indexer, _ = prepare(catalog.engineered(spark, SF001), TrainParams())
    assert max(nominal.values()) + 1 <= bins_for(indexer, TrainParams())  # arity fits the bins


def test_longer_city_list_trains(spark):
    """96 cities give 385 season x city values: the bins follow the categories."""
    from airshed.params import TrainParams
    from airshed.plans.train import bins_for, gbt_estimator, prepare
    eng = catalog.engineered(spark, SF001)
    twice = eng.unionByName(eng.withColumn("city", F.concat(F.lit("New "), "city")))
    seasons = F.concat("regional_season", F.lit(" "), (F.pmod(F.xxhash64("time"), F.lit(3))).cast("string"))
    indexer, split = prepare(twice.withColumn("regional_season", seasons), TrainParams())
    bins = bins_for(indexer, TrainParams())
    assert bins > 256
    model = gbt_estimator(TrainParams(), 1, bins).fit(split.where(~F.col("is_test")).drop("is_test"))
    assert model.transform(split.where("is_test").drop("is_test")).where("prediction is null").count() == 0


# (rain, wind, temp, humidity) around every bound, with missing values, and the label due.
VERDICTS = [
    ((2.0, 15.0, 28.0, 70.0), "Pleasant / Normal"), ((2.1, None, None, None), "Rainy / Washed"),
    ((None, 15.1, None, None), "Windy & Clear"), ((2.0, 16.0, 10.0, 10.0), "Windy & Clear"),
    ((0.0, 4.9, 17.9, None), "Cold & Stagnant"), ((0.0, None, 10.0, 50.0), "Pleasant / Normal"),
    ((0.0, 5.0, 10.0, 50.0), "Pleasant / Normal"), ((None, 4.0, 36.0, 39.0), "Hot & Dry"),
    ((0.0, 6.0, 36.0, 40.0), "Pleasant / Normal"), ((0.0, 6.0, 36.0, 71.0), "Hot & Humid"),
    ((0.0, 6.0, 29.0, 70.1), "Hot & Humid"), ((0.0, 6.0, 29.0, None), "Pleasant / Normal"),
    ((5.0, 20.0, 40.0, 90.0), "Rainy / Washed"), ((None, None, None, None), "Pleasant / Normal"),
]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(VERDICTS), min_size=1, max_size=40))
def test_weather_verdict_cases_in_any_order(spark, cases):
    from airshed.functions.weather import weather_verdict
    df = spark.createDataFrame([row for row, _ in cases], "r double, w double, t double, h double")
    got = [x.v for x in df.select(weather_verdict(F.col("t"), F.col("h"), F.col("w"), F.col("r")).alias("v")).collect()]
    assert got == [label for _, label in cases]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 360, allow_nan=False), min_size=1, max_size=50))
def test_wind_direction_unit_circle(spark, degrees):
    import math

    from airshed.functions.model_features import build_features
    from tests.test_features import _engineered_row
    df = None
    for d in degrees:
        one = _engineered_row(spark, wind_direction_10m=d)
        df = one if df is None else df.unionByName(one)
    for r in build_features(df).collect():
        assert math.isclose(r.wind_dir_sin ** 2 + r.wind_dir_cos ** 2, 1.0, rel_tol=1e-12)


def test_hyperparameter_mapping_reaches_the_model(spark):
    from airshed.params import TrainParams
    from airshed.plans.train import make_gbt
    g = make_gbt(TrainParams())
    b = TrainParams().boost
    assert g.getMaxIter() == b.n_estimators == 900
    assert (g.getMaxDepth(), g.getStepSize(), g.getMinInstancesPerNode()) == (7, 0.035, 15)
    assert (g.getSubsamplingRate(), g.getFeatureSubsetStrategy(), g.getLossType()) == (1.0, "all", "squared")
    assert (g.getMaxBins(), g.getSeed(), g.getCheckpointInterval()) == (256, 42, 10)
