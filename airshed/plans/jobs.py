"""W1-W8 as runnable jobs: stage functions wrapped with sources and sinks.

    python -m airshed.plans.jobs gather   --landing L --warehouse W [--feed aqi|weather]
                                          [--start-date D] [--end-date D]
    python -m airshed.plans.jobs merge    --warehouse W
    python -m airshed.plans.jobs engineer --warehouse W
    python -m airshed.plans.jobs train    --warehouse W --model pm25_predictor
                                          [--n-estimators N] [--max-depth N] [--learning-rate X] ...
    python -m airshed.plans.jobs all      --landing L --warehouse W [--buckets N]
    python -m airshed.plans.jobs export   --warehouse W --out O      (stage tables as CSV)

``--input-format csv`` reads the stage inputs of merge / engineer / train as
header CSV files (the text hand-off of the original job).

Stages hand off as Parquet under the warehouse folder; every write overwrites
its own folder, so a re-run after a failure is idempotent.  Row counts per
stage (A3) come from ``DataFrame.observe`` on the write itself -- no extra job.
"""

from __future__ import annotations

import argparse
import dataclasses
import datetime as dt
import hashlib
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from airshed import schemas
from airshed.params import MODEL_VARIANTS, BoostParams, GatherParams, TrainParams
from airshed.plans import stages
from airshed.session import build_session, clear_scratch, ensure_checkpoint_dir
from airshed.sources.cities import dim_city, select_cities
from airshed.sources.files import read_bucketed, read_csv, read_stage, write_bucketed, write_csv, write_stage
from airshed.sources.payload import FEEDS, accepted, files_for, read_payloads, rejects, write_hourly, write_manifest

log = logging.getLogger("airshed.jobs")

STAGE_SCHEMAS = {
    "raw_aqi": schemas.RAW_AQI, "raw_weather": schemas.RAW_WEATHER,
    "merged": schemas.MERGED, "engineered": schemas.ENGINEERED,
}


KEYS = ["city", "time"]


def table_name(stage: str, warehouse: str) -> str:
    """Catalog name of a bucketed stage table, unique per warehouse folder."""
    tag = hashlib.md5(warehouse.rstrip("/").encode()).hexdigest()[:10]
    return f"airshed_{stage}_{tag}"


def observed_write(df: DataFrame, path: str, stage: str, buckets: int | None = None) -> int:
    """Write a stage (Parquet, or bucketed on (city, time)) and return its
    row count, taken by ``observe`` during the write itself."""
    obs = Observation(stage)
    df = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    if buckets:
        warehouse = path.rsplit("/", 1)[0]
        write_bucketed(df, table_name(stage, warehouse), path, KEYS, buckets)
    else:
        write_stage(df, path)
    n = int(obs.get.get("rows", 0))
    log.info("stage %s: %d rows -> %s", stage, n, path)
    return n


def read_input(spark: SparkSession, warehouse: str, stage: str, fmt: str = "parquet") -> DataFrame:
    """A stage table by name: Parquet (the hand-off) or header CSV (S7), the
    text files the original job exchanged between its stages."""
    schema = STAGE_SCHEMAS[stage]
    path = f"{warehouse}/{stage}"
    return read_csv(spark, path, schema) if fmt == "csv" else read_stage(spark, path, schema)


def export_csv(spark: SparkSession, warehouse: str, out: str,
               stages_: tuple[str, ...] = ("raw_aqi", "raw_weather", "merged", "engineered")) -> None:
    """Every stage table as header CSV under ``out/<stage>``."""
    for stage in stages_:
        write_csv(read_input(spark, warehouse, stage), f"{out}/{stage}")


def gather(spark: SparkSession, landing: str, warehouse: str, feed: str,
           gp: GatherParams = GatherParams(), buckets: int | None = None,
           multiline: bool = False) -> int:
    """Landed payloads -> hourly_<feed>, rejects_<feed>, raw_<feed>, counts_<feed>.

    Files that the landing manifest (:func:`index`) places outside the dates aren't opened.
    The JSON is parsed once, into ``hourly_<feed>``.  ``counts_<feed>`` has the
    rows of each city.  With ``buckets``, raw_<feed> is a bucketed table on
    (city, time) so that :func:`merge` joins the two feeds without any exchange."""
    path, manifest = f"{landing}/feed={feed}", f"{landing}/manifest_{feed}"
    files = files_for(spark, path, manifest, gp.start_date, gp.end_date)
    payloads = select_cities(read_payloads(spark, path, FEEDS[feed], multiline, files), gp.cities)
    write_hourly(payloads, feed, f"{warehouse}/hourly_{feed}")
    observed_write(rejects(spark, f"{warehouse}/hourly_{feed}", feed), f"{warehouse}/rejects_{feed}", f"rejects_{feed}")
    n = observed_write(gather_frame(spark, warehouse, feed, gp), f"{warehouse}/raw_{feed}", f"raw_{feed}", buckets)
    counts = read_stage(spark, f"{warehouse}/raw_{feed}").groupBy("city").agg(F.count(F.lit(1)).alias("rows"))
    write_stage(counts.coalesce(1), f"{warehouse}/counts_{feed}")  # one row per city
    return n


def index(spark: SparkSession, landing: str, feed: str, multiline: bool = False) -> None:
    """Describes newly landed files in ``<landing>/manifest_<feed>``; run it whenever files land."""
    write_manifest(spark, f"{landing}/feed={feed}", feed, f"{landing}/manifest_{feed}", multiline)


def gather_frame(spark: SparkSession, warehouse: str, feed: str, gp: GatherParams = GatherParams()) -> DataFrame:
    """raw_<feed> before writing, from the hourly stage and the written reject table."""
    rejected = read_stage(spark, f"{warehouse}/rejects_{feed}", schemas.REJECTS)
    rows = accepted(spark, f"{warehouse}/hourly_{feed}", feed, rejected, gp.start_date, gp.end_date)
    return stages.gather_aqi(rows) if feed == "aqi" else stages.gather_weather(rows)


def merge(spark: SparkSession, warehouse: str, buckets: int | None = None, fmt: str = "parquet") -> int:
    """raw_aqi x raw_weather -> merged (from bucketed tables: no exchange)."""
    if buckets:
        aqi, weather = (read_bucketed(spark, table_name(s, warehouse), f"{warehouse}/{s}", STAGE_SCHEMAS[s], KEYS, buckets)
                        for s in ("raw_aqi", "raw_weather"))
    else:
        aqi = read_input(spark, warehouse, "raw_aqi", fmt)
        weather = read_input(spark, warehouse, "raw_weather", fmt)
    return observed_write(stages.merge(aqi, weather), f"{warehouse}/merged", "merged")


def engineer(spark: SparkSession, warehouse: str, fmt: str = "parquet") -> int:
    """Merged -> engineered."""
    merged = read_input(spark, warehouse, "merged", fmt)
    out = stages.engineer(merged, dim_city(spark))
    return observed_write(out, f"{warehouse}/engineered", "engineered")


def train(spark: SparkSession, warehouse: str, name: str, trees: int | None = None,
          params: TrainParams | None = None, fmt: str = "parquet", version: int = 1) -> dict:
    """Engineered -> model (a node table per version), fold results, metrics, params."""
    from airshed.operators import trees as node_trees
    from airshed.plans.train import params_table
    from airshed.plans.train import train as fit
    params = params or dataclasses.replace(TrainParams(), target=MODEL_VARIANTS.get(name, "pm2_5"))
    eng = read_input(spark, warehouse, "engineered", fmt)
    res = fit(spark, eng, name, params, max_iter=trees)
    base = f"{warehouse}/models/model={name}"
    node_trees.save(res.model, f"{base}/nodes", version)
    write_per_model(res.fold_results, f"{warehouse}/fold_results", name)
    write_per_model(res.metrics, f"{warehouse}/metrics", name)
    write_per_model(params_table(spark, name, params), f"{warehouse}/params", name)
    if res.importance is not None:
        write_per_model(res.importance, f"{warehouse}/importance", name)
    metrics = read_stage(spark, f"{warehouse}/metrics").where(F.col("model") == name)
    return {r["metric"]: r["value"] for r in metrics.collect()}  # 25 rows, written above


def write_per_model(df: DataFrame, path: str, name: str) -> None:
    """One table per kind, partitioned by ``model``; dynamic partition
    overwrite replaces only this model's partition (re-runs are idempotent,
    other variants stay)."""
    if "model" not in df.columns:
        df = df.withColumn("model", F.lit(name))
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("model").parquet(path))


def run_all(spark: SparkSession, landing: str, warehouse: str, models: list[str] | None = None,
            buckets: int | None = None, gp: GatherParams = GatherParams(), params: TrainParams = TrainParams(),
            multiline: bool = False) -> None:
    for feed in FEEDS:
        gather(spark, landing, warehouse, feed, gp, buckets, multiline)
    merge(spark, warehouse, buckets)
    engineer(spark, warehouse)
    for name in models or list(MODEL_VARIANTS):
        train(spark, warehouse, name, params=dataclasses.replace(params, target=MODEL_VARIANTS[name]))


def boost_fields() -> list[dataclasses.Field]:
    return list(dataclasses.fields(BoostParams))


def parse_args(argv: list[str] | None) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="airshed.plans.jobs")
    ap.add_argument("stage", choices=["index", "gather", "merge", "engineer", "train", "all", "export"])
    ap.add_argument("--input-format", choices=["parquet", "csv"], default="parquet",
                    help="format of the stage tables read from the warehouse")
    ap.add_argument("--out", help="export: folder for the CSV copies")
    ap.add_argument("--multiline", action="store_true",
                    help="landed files hold one pretty-printed payload each")
    ap.add_argument("--landing")
    ap.add_argument("--warehouse", required=True)
    ap.add_argument("--feed", choices=list(FEEDS))
    ap.add_argument("--model", choices=list(MODEL_VARIANTS), action="append",
                    help="train: the variant (default pm25_predictor); all: may be repeated (default: every variant)")
    ap.add_argument("--start-date", type=dt.date.fromisoformat, default=GatherParams.start_date)
    ap.add_argument("--end-date", type=dt.date.fromisoformat, default=GatherParams.end_date)
    ap.add_argument("--test-size", type=float, default=TrainParams.test_size)
    ap.add_argument("--folds", type=int, default=TrainParams.n_folds)
    ap.add_argument("--cv-parallelism", type=int, default=TrainParams.cv_parallelism)
    for f in boost_fields():  # every hyperparameter, by its configured name
        ap.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    ap.add_argument("--master", default=None)
    ap.add_argument("--buckets", type=int, default=None,
                    help="bucket raw tables on (city, time) so the merge needs no shuffle")
    return ap.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    a = parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    owned = SparkSession.getActiveSession() is None
    spark = build_session(a.master)
    ensure_checkpoint_dir(spark)
    fmt = a.input_format
    gp = GatherParams(start_date=a.start_date, end_date=a.end_date)
    params = TrainParams(test_size=a.test_size, n_folds=a.folds, cv_parallelism=a.cv_parallelism,
                         boost=BoostParams(**{f.name: getattr(a, f.name) for f in boost_fields()}))
    if a.stage == "index":
        for feed in [a.feed] if a.feed else list(FEEDS):
            index(spark, a.landing, feed, a.multiline)
    elif a.stage == "gather":
        for feed in [a.feed] if a.feed else list(FEEDS):
            gather(spark, a.landing, a.warehouse, feed, gp, a.buckets, a.multiline)
    elif a.stage == "merge":
        merge(spark, a.warehouse, a.buckets, fmt)
    elif a.stage == "engineer":
        engineer(spark, a.warehouse, fmt=fmt)
    elif a.stage == "train":
        for name in a.model or ["pm25_predictor"]:
            print(train(spark, a.warehouse, name, params=dataclasses.replace(params, target=MODEL_VARIANTS[name]), fmt=fmt))
    elif a.stage == "export":
        export_csv(spark, a.warehouse, a.out)
    else:
        run_all(spark, a.landing, a.warehouse, a.model, a.buckets, gp, params, a.multiline)
    if owned:
        clear_scratch(spark)
        spark.stop()


if __name__ == "__main__":
    main()
