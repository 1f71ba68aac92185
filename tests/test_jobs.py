"""End to end: landed payloads -> stages on disk -> trained model and metrics."""

import pytest
from pyspark.sql import functions as F

from airshed import catalog
from airshed.plans import jobs
from airshed.schemas import AQI_VARS, WEATHER_VARS
from airshed.sources.adapter import hourly_aqi, hourly_weather
from tests.conftest import SF001


@pytest.fixture(scope="module")
def warehouse(spark):
    import tempfile
    base = tempfile.mkdtemp(prefix="airshed-jobs-")
    a = catalog._land(spark, hourly_aqi(spark, SF001), "aqi", AQI_VARS, defects=True)
    w = catalog._land(spark, hourly_weather(spark, SF001), "weather", WEATHER_VARS)
    landing = f"{base}/landing"
    # both feeds under one landing root
    spark.read.text(a).write.partitionBy("city").text(f"{landing}/feed=aqi")
    spark.read.text(w).write.partitionBy("city").text(f"{landing}/feed=weather")
    wh = f"{base}/warehouse"
    n_aqi = jobs.gather(spark, landing, wh, "aqi")
    n_weather = jobs.gather(spark, landing, wh, "weather")
    n_merged = jobs.merge(spark, wh)
    n_eng = jobs.engineer(spark, wh)
    return wh, (n_aqi, n_weather, n_merged, n_eng)


def test_stage_counts(spark, warehouse):
    wh, (n_aqi, n_weather, n_merged, n_eng) = warehouse
    rej = spark.read.parquet(f"{wh}/rejects_aqi")
    assert rej.count() == 18  # 6 defect kinds x 3 cities
    assert n_eng == n_merged > 0
    assert n_aqi < catalog.raw_aqi(spark, SF001).count()  # rejected cities gone
    assert n_weather == catalog.raw_weather(spark, SF001).count()
    eng = spark.read.parquet(f"{wh}/engineered")
    bad = {r.city for r in rej.collect()}
    assert eng.where(F.col("city").isin(*bad)).count() == 0


def test_train_writes_model_and_metrics(spark, warehouse):
    wh, _ = warehouse
    metrics = jobs.train(spark, wh, "pm10_forecaster", trees=2)
    assert len(metrics) == 25 and "test_r2" in metrics
    assert {"mean_train_r2", "mean_cv_r2", "generalization_gap", "fold_5_gap"} <= set(metrics)
    folds = spark.read.parquet(f"{wh}/fold_results/model=pm10_forecaster")
    assert folds.columns == ["Fold", "Train_R2", "CV_R2", "Gap"] and folds.count() == 5
    imp = spark.read.parquet(f"{wh}/importance/model=pm10_forecaster")
    assert imp.count() == 22
    # a second variant keeps the first one's partition; whole tables read back
    jobs.train(spark, wh, "pm25_predictor", trees=1)
    allm = spark.read.parquet(f"{wh}/metrics")
    assert {r.model for r in allm.select("model").distinct().collect()} == {"pm10_forecaster", "pm25_predictor"}
    assert allm.count() == 50
    assert spark.read.parquet(f"{wh}/fold_results").count() == 10
    from airshed.operators import trees
    nodes = trees.load(spark, f"{wh}/models/model=pm10_forecaster/nodes")
    assert nodes.where("fold = 0 AND node = 1").count() == 2 and nodes.select("fold").distinct().count() == 6
    fm = catalog.build_features(spark.read.parquet(f"{wh}/engineered"), target="pm10")
    assert trees.predict(fm, nodes).where(F.col("prediction").isNull()).count() == 0


def test_bucketed_hand_off_merges_without_exchange(spark, warehouse):
    """Gather here, merge in a catalog that has never seen the tables (as another process would)."""
    import tempfile
    wh, (_, _, n_merged, _) = warehouse
    landing = wh.replace("/warehouse", "/landing")
    wh2 = tempfile.mkdtemp(prefix="airshed-bucketed-")
    jobs.gather(spark, landing, wh2, "aqi", buckets=4)
    jobs.gather(spark, landing, wh2, "weather", buckets=4)
    for stage in ("raw_aqi", "raw_weather"):
        spark.sql(f"DROP TABLE {jobs.table_name(stage, wh2)}")  # external: the files stay
    assert jobs.merge(spark, wh2, buckets=4) == n_merged
    aqi, weather = (spark.table(jobs.table_name(s, wh2)) for s in ("raw_aqi", "raw_weather"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        plan = catalog.stages.merge(aqi, weather)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_bucketed_merge_as_its_own_process(spark, warehouse):
    import os
    import subprocess
    import sys
    import tempfile
    wh, (_, _, n_merged, _) = warehouse
    landing = wh.replace("/warehouse", "/landing")
    wh2 = tempfile.mkdtemp(prefix="airshed-bucketed-")
    for feed in ("aqi", "weather"):
        jobs.gather(spark, landing, wh2, feed, buckets=3)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-m", "airshed", "merge", "--warehouse", wh2, "--buckets", "3", "--master", "local[2]"],
                   cwd=tempfile.mkdtemp(prefix="airshed-cwd-"), check=True, timeout=300,
                   env=os.environ | {"PYTHONPATH": root}, capture_output=True)
    assert spark.read.parquet(f"{wh2}/merged").count() == n_merged


def test_dates_and_hyperparameters_from_the_command_line(spark, warehouse):
    import datetime as dt
    import tempfile

    from airshed.operators import trees
    wh, _ = warehouse
    out = tempfile.mkdtemp(prefix="airshed-cli-")
    jobs.main(["all", "--landing", wh.replace("/warehouse", "/landing"), "--warehouse", out, "--model", "pm10_predictor",
               "--start-date", "2024-02-01", "--end-date", "2024-06-15", "--n-estimators", "2", "--max-depth", "3",
               "--learning-rate", "0.5", "--folds", "3"])
    eng = spark.read.parquet(f"{out}/engineered")
    first, last = eng.agg({"time": "min"}).first()[0], eng.agg({"time": "max"}).first()[0]
    assert first >= dt.datetime(2024, 2, 1) and last < dt.datetime(2024, 6, 16) and eng.count() > 100
    nodes = trees.load(spark, f"{out}/models/model=pm10_predictor/nodes")
    seen = nodes.where("fold = 0").agg({"tree": "max", "depth": "max"}).first()
    assert seen["max(tree)"] == 1 and seen["max(depth)"] <= 3
    assert spark.read.parquet(f"{out}/fold_results").count() == 3
    params = {r.param: r.value for r in spark.read.parquet(f"{out}/params").collect()}
    assert params["max_depth"] == "3" and params["reg_lambda"] == "10.0"


def test_rows_per_city_are_counted(spark, warehouse):
    wh, (n_aqi, _, _, _) = warehouse
    counts = {r.city: r["rows"] for r in spark.read.parquet(f"{wh}/counts_aqi").collect()}
    assert sum(counts.values()) == n_aqi
    assert counts == {r.city: r["count"] for r in spark.read.parquet(f"{wh}/raw_aqi").groupBy("city").count().collect()}


def test_csv_export_and_csv_inputs(spark, warehouse):
    import tempfile
    wh, (_, _, n_merged, n_eng) = warehouse
    # CSV-only folders (as the original job leaves behind) feed the next stages
    out1 = tempfile.mkdtemp(prefix="airshed-export-")
    jobs.main(["export", "--warehouse", wh, "--out", out1])
    assert jobs.merge(spark, out1, fmt="csv") == n_merged  # raw CSV -> merged
    out2 = tempfile.mkdtemp(prefix="airshed-export-")
    jobs.export_csv(spark, wh, out2)
    assert jobs.engineer(spark, out2, fmt="csv") == n_eng  # merged CSV -> engineered
    a = spark.read.parquet(f"{wh}/engineered")
    b = spark.read.parquet(f"{out2}/engineered")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stage_grain_is_unique_on_city_time(spark, warehouse):
    wh, _ = warehouse
    for stage in ("raw_aqi", "raw_weather", "merged", "engineered"):
        df = spark.read.parquet(f"{wh}/{stage}")
        assert df.count() == df.select("city", "time").distinct().count(), stage


def test_train_from_csv_engineered(spark, warehouse):
    import tempfile
    wh, _ = warehouse
    out = tempfile.mkdtemp(prefix="airshed-csv-train-")
    jobs.export_csv(spark, wh, out, stages_=("engineered",))
    metrics = jobs.train(spark, out, "pm25_predictor", trees=1, fmt="csv")
    assert len(metrics) == 25 and -1.0 <= metrics["mean_cv_r2"] <= 1.0


def test_gather_plan_has_one_exchange(spark, warehouse):
    import re
    wh, _ = warehouse
    out = jobs.gather_frame(spark, wh, "aqi")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = out._jdf.queryExecution().explainString(mode)
    exchanges = re.findall(r"^\(\d+\) Exchange", text, flags=re.M)  # numbered node details
    assert len(exchanges) == 1, text                   # the resample's only; rejects are broadcast
    assert spark.read.parquet(f"{wh}/rejects_aqi").count() == 18


def test_region_check_reads_one_column(spark, warehouse):
    from airshed.operators.region import cities_without_region
    from airshed.sources.cities import dim_city
    wh, _ = warehouse
    check = cities_without_region(spark.read.parquet(f"{wh}/merged"), dim_city(spark))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = check._jdf.queryExecution().explainString(mode)
    schema = [ln for ln in text.splitlines() if "ReadSchema" in ln]
    assert schema and schema[0].strip().endswith("struct<city:string>")  # one column read
    assert "BroadcastHashJoin LeftAnti" in text and "SortMergeJoin" not in text
    assert check.count() == 0
