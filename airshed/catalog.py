"""Registered queries: one per operator of the inventory, each with its SQL.

Every query reads the driver's tables (``lineitem`` through the feed adapter)
at the given scale directory, so its work grows with the data.  Doubles are
rounded to 6 digits for cross-engine comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed import oracle as O
from airshed.compare import round_doubles
from airshed.functions.model_features import build_features, day_ordinal
from airshed.operators.crossval import SUMMARY_COLS
from airshed.operators.region import cities_without_region
from airshed.operators.resample import drop_incomplete_rows, resample
from airshed.params import BoostParams
from airshed.plans import stages
from airshed.schemas import AQI_AGG, CATEGORICAL, FEATURES, NUMERIC, WEATHER_AGG
from airshed.session import pinned
from airshed.sources.adapter import hourly_aqi, hourly_weather
from airshed.sources.cities import dim_city

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------- building blocks

def raw_aqi(spark: SparkSession, sf: str) -> DataFrame:
    return stages.gather_aqi(hourly_aqi(spark, sf))


def raw_weather(spark: SparkSession, sf: str) -> DataFrame:
    return stages.gather_weather(hourly_weather(spark, sf))


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return stages.merge(raw_aqi(spark, sf), raw_weather(spark, sf))


def engineered(spark: SparkSession, sf: str) -> DataFrame:
    return stages.engineer(merged(spark, sf), dim_city(spark))


def features(spark: SparkSession, sf: str, target: str = "pm2_5") -> DataFrame:
    return build_features(engineered(spark, sf), target=target, keep=("time",))


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


MERGED_COLS = O.ENGINEERED_COLS[:10]

# ---------------------------------------------------------------- A1, A2, P3


@register("resample_aqi", O.with_base(O.select_rounded(["time", "city", "pm10", "pm2_5"], "raw_aqi")))
def q_resample_aqi(spark, sf):
    return round_doubles(raw_aqi(spark, sf))


@register("resample_weather", O.with_base(O.select_rounded(
    ["time", "city", "temperature_2m", "relative_humidity_2m", "wind_speed_10m",
     "wind_direction_10m", "precipitation", "surface_pressure"], "raw_weather")))
def q_resample_weather(spark, sf):
    return round_doubles(raw_weather(spark, sf))


_DROPNA_SQL = O.with_base("""
SELECT 'aqi' AS feed, count(*) AS n_bins,
       count(*) FILTER (WHERE pm10 IS NOT NULL AND pm2_5 IS NOT NULL) AS n_complete
FROM (SELECT time_bucket(INTERVAL 6 HOUR, time) AS bin, city, avg(pm10) AS pm10, avg(pm2_5) AS pm2_5
      FROM hourly_aqi GROUP BY 1, 2) a
UNION ALL
SELECT 'weather' AS feed, count(*) AS n_bins,
       count(*) FILTER (WHERE t IS NOT NULL AND h IS NOT NULL AND ws IS NOT NULL
                        AND wd IS NOT NULL AND p IS NOT NULL AND sp IS NOT NULL) AS n_complete
FROM (SELECT time_bucket(INTERVAL 6 HOUR, time) AS bin, city, avg(temperature_2m) AS t,
             avg(relative_humidity_2m) AS h, avg(wind_speed_10m) AS ws,
             avg(wind_direction_10m) AS wd, coalesce(sum(precipitation), 0.0) AS p,
             avg(surface_pressure) AS sp
      FROM hourly_weather GROUP BY 1, 2) w
""")


@register("dropna_any", _DROPNA_SQL)
def q_dropna_any(spark, sf):
    """Bins before and after dropping incomplete rows, per feed."""
    from airshed.operators.merge import union_frames
    out = []
    for feed, hourly, how in (("aqi", hourly_aqi(spark, sf), AQI_AGG),
                              ("weather", hourly_weather(spark, sf), WEATHER_AGG)):
        binned = resample(hourly, how, drop_incomplete=False)
        for rows, counted in ((binned, "n_bins"), (drop_incomplete_rows(binned), "n_complete")):
            out.append(rows.agg(F.lit(feed).alias("feed"), F.lit(counted).alias("k"), F.count(F.lit(1)).alias("n")))
    return union_frames(out).groupBy("feed").agg(
        F.max(F.when(F.col("k") == "n_bins", F.col("n"))).alias("n_bins"),
        F.max(F.when(F.col("k") == "n_complete", F.col("n"))).alias("n_complete"))


# ---------------------------------------------------------------- J1


@register("merge_city_time", O.with_base(O.select_rounded(MERGED_COLS, "merged")))
def q_merge(spark, sf):
    return round_doubles(merged(spark, sf))


# ---------------------------------------------------------------- F1-F7, J2


@register("weather_verdict", O.with_base(
    "SELECT weather_verdict, count(*) AS n FROM cal GROUP BY weather_verdict"))
def q_weather_verdict(spark, sf):
    from airshed.functions.weather import add_weather_verdict
    return (merged(spark, sf).transform(add_weather_verdict)
            .groupBy("weather_verdict").agg(F.count(F.lit(1)).alias("n")))


@register("time_parts", O.with_base(
    "SELECT time, city, month, hour, day_of_week FROM cal"))
def q_time_parts(spark, sf):
    from airshed.functions.calendar import add_time_features
    return merged(spark, sf).transform(add_time_features) \
        .select("time", "city", "month", "hour", "day_of_week")


@register("time_of_day", O.with_base(
    "SELECT hour, time_of_day, count(*) AS n FROM cal GROUP BY hour, time_of_day"))
def q_time_of_day(spark, sf):
    from airshed.functions.calendar import add_time_features
    return (merged(spark, sf).transform(add_time_features)
            .groupBy("hour", "time_of_day").agg(F.count(F.lit(1)).alias("n")))


@register("is_weekend", O.with_base(
    "SELECT day_of_week, is_weekend, count(*) AS n FROM cal GROUP BY day_of_week, is_weekend"))
def q_is_weekend(spark, sf):
    from airshed.functions.calendar import add_time_features
    return (merged(spark, sf).transform(add_time_features)
            .groupBy("day_of_week", "is_weekend").agg(F.count(F.lit(1)).alias("n")))


@register("region_lookup", O.with_base(
    "SELECT city, region, count(*) AS n FROM engineered GROUP BY city, region"))
def q_region_lookup(spark, sf):
    return engineered(spark, sf).groupBy("city", "region").agg(F.count(F.lit(1)).alias("n"))


@register("region_missing", O.with_base(
    "SELECT DISTINCT city FROM merged WHERE city NOT IN "
    "(SELECT city FROM dim_city WHERE region <> 'UT')"))
def q_region_missing(spark, sf):
    """Cities without a region, against a dimension lacking 'UT'."""
    dim = dim_city(spark).where(F.col("region") != "UT")
    return cities_without_region(merged(spark, sf), dim)


@register("regional_season", O.with_base(
    "SELECT region, month, regional_season, count(*) AS n FROM engineered "
    "GROUP BY region, month, regional_season"))
def q_regional_season(spark, sf):
    return (engineered(spark, sf).groupBy("region", "month", "regional_season")
            .agg(F.count(F.lit(1)).alias("n")))


@register("engineered_features", O.with_base(O.select_rounded(O.ENGINEERED_COLS, "engineered")))
def q_engineered(spark, sf):
    return round_doubles(engineered(spark, sf))


# ---------------------------------------------------------------- F8-F16, J3, P4, P5

FM_COLS = ["time", "city", "temperature_2m", "relative_humidity_2m", "wind_speed_10m",
           "precipitation", "surface_pressure", "time_of_day", "is_weekend",
           "weather_verdict", "season_region", "season_city", "temp_humidity",
           "wind_precip", "pressure_temp", "wind_dir_sin", "wind_dir_cos",
           "dow_sin", "dow_cos", "month_sin", "month_cos", "hour_sin", "hour_cos", "label"]


@register("feature_matrix", O.with_base(O.select_rounded(FM_COLS, "fm", {"label": "pm2_5"})))
def q_feature_matrix(spark, sf):
    return round_doubles(features(spark, sf))


@register("feature_matrix_pm10", O.with_base(O.select_rounded(FM_COLS, "fm", {"label": "pm10"})))
def q_feature_matrix_pm10(spark, sf):
    """The pm10 variants train on pm10 (target is a parameter)."""
    return round_doubles(features(spark, sf, target="pm10"))


@register("season_crosses", O.with_base(
    "SELECT season_region, season_city, count(*) AS n FROM fm GROUP BY season_region, season_city"))
def q_season_crosses(spark, sf):
    return features(spark, sf).groupBy("season_region", "season_city") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("interactions", O.with_base(O.select_rounded(
    ["time", "city", "temp_humidity", "wind_precip", "pressure_temp"], "fm")))
def q_interactions(spark, sf):
    return round_doubles(features(spark, sf).select(
        "time", "city", "temp_humidity", "wind_precip", "pressure_temp"))


@register("wind_sin_cos", O.with_base(O.select_rounded(
    ["time", "city", "wind_dir_sin", "wind_dir_cos"], "fm")))
def q_wind(spark, sf):
    return round_doubles(features(spark, sf).select("time", "city", "wind_dir_sin", "wind_dir_cos"))


CYC = ["dow_sin", "dow_cos", "month_sin", "month_cos", "hour_sin", "hour_cos"]


@register("cyclic_time", O.with_base(O.select_rounded(["time", "city", *CYC], "fm")))
def q_cyclic(spark, sf):
    return round_doubles(features(spark, sf).select("time", "city", *CYC))


@register("dow_ordinal", O.with_base(
    "SELECT day_of_week, cast(isodow(time) - 1 AS integer) AS dow, count(*) AS n "
    "FROM cal GROUP BY day_of_week, dow"))
def q_dow(spark, sf):
    return (engineered(spark, sf).select("day_of_week", day_ordinal(F.col("day_of_week")).alias("dow"))
            .groupBy("day_of_week", "dow").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- M1, M2, F17

def _keys(spark, sf):
    """The keys of the feature table, written once: counting and cutting read only them."""
    return pinned(spark, features(spark, sf).select("time", "city"), "keys")


def _coded(spark, sf):
    from pyspark.ml import Pipeline

    from airshed.plans.train import categorical_indexer
    fm = features(spark, sf)
    return Pipeline(stages=[categorical_indexer()]).fit(fm).transform(fm)


@register("train_test_split", O.with_cv("SELECT time, city, is_test FROM split"))
def q_split(spark, sf):
    """M1 exact: ceil(0.2 n) test rows, smallest md5(city|time|seed) first."""
    from airshed.operators.split import split_exact
    return split_exact(_keys(spark, sf), 0.2, 42)


@register("train_test_split_hash", O.with_base(
    "SELECT time, city, substr(md5(city || '|' || cast(time AS varchar) || '|42'), 1, 8) "
    "< '33333333' AS is_test FROM fm"))
def q_split_hash(spark, sf):
    """M1 hash mode: a row is test when its md5 prefix is below 0.2 * 2^32."""
    from airshed.operators.split import split_hash
    return split_hash(features(spark, sf).select("time", "city"), 0.2, 42)


@register("kfold_assign", O.with_cv("SELECT time, city, cast(fold AS integer) AS fold FROM folds"))
def q_folds(spark, sf):
    """M2: exact 5 folds over the training rows."""
    from airshed.operators.split import assign_folds, split_exact
    s = split_exact(_keys(spark, sf), 0.2, 42)
    return assign_folds(s.where(~F.col("is_test")).drop("is_test"), 5, 42)


@register("kfold_assign_hash", O.with_cv(
    "SELECT time, city, cast(cast(('0x' || substr(hcv, 1, 8)) AS BIGINT) % 5 + 1 AS integer) AS fold "
    "FROM split WHERE NOT is_test"))
def q_folds_hash(spark, sf):
    """M2 hash mode: fold = md5 prefix modulo 5 (no sort, sizes ~n/5)."""
    from airshed.operators.split import assign_folds, split_exact
    s = split_exact(_keys(spark, sf), 0.2, 42)
    return assign_folds(s.where(~F.col("is_test")).drop("is_test"), 5, 42, exact=False)


_CODE_SQL = O.with_base(
    "SELECT time, city, "
    + ", ".join(f"cast(dense_rank() OVER (ORDER BY {c}) - 1 AS integer) AS {c}_code"
                for c in ["city", "weather_verdict", "time_of_day", "season_region", "season_city"])
    + " FROM fm")


@register("categorical_codes", _CODE_SQL)
def q_codes(spark, sf):
    """sorted-category codes learned on all rows."""
    from airshed.schemas import CATEGORICAL
    coded = _coded(spark, sf)
    return coded.select("time", "city", *[F.col(c + "_code").cast("int").alias(c + "_code")
                                          for c in CATEGORICAL])


# ---------------------------------------------------------------- M4, A5, A6, M6, S12

def _cv_group_mean(spark, sf):
    from airshed.operators.estimators import GroupMeanRegressor
    from airshed.plans.train import train
    return train(spark, engineered(spark, sf), "pm25_predictor",
                 estimator=GroupMeanRegressor(groupCol="city"))


@register("cv_r2_by_fold", O.with_cv(
    f"SELECT cast(fold AS integer) AS fold, part, {O.r6('r2')} AS r2 FROM r2"))
def q_cv_r2(spark, sf):
    """A5 / M4: R^2 per (fold, part) with a mean-per-city estimator."""
    from airshed.operators.crossval import cross_validate
    from airshed.operators.estimators import GroupMeanRegressor
    from airshed.operators.split import assign_folds, split_exact
    fm = pinned(spark, features(spark, sf).select("time", "city", "label"), "labels")
    s = split_exact(fm, 0.2, 42)
    folded = assign_folds(s.where(~F.col("is_test")).drop("is_test"), 5, 42)
    r2 = cross_validate(folded, GroupMeanRegressor(groupCol="city"), 5)
    return round_doubles(r2.withColumn("fold", F.col("fold").cast("int")))


@register("fold_results", O.with_cv(
    f"SELECT Fold, {O.r6('Train_R2')} AS Train_R2, {O.r6('CV_R2')} AS CV_R2, "
    f"{O.r6('Gap')} AS Gap FROM fold_tbl"))
def q_fold_results(spark, sf):
    """M6 / S11 table: Fold, Train_R2, CV_R2, Gap."""
    return round_doubles(_cv_group_mean(spark, sf).fold_results)


_SUMMARY = SUMMARY_COLS


@register("cv_summary", O.with_cv(
    "SELECT " + ", ".join(f"{O.r6(c)} AS {c}" for c in _SUMMARY) + " FROM summary"))
def q_cv_summary(spark, sf):
    """Mean, population std, best, worst; generalisation gap."""
    return round_doubles(_cv_group_mean(spark, sf).summary)


_METRICS_SQL = O.with_cv(
    "SELECT 'pm25_predictor' AS model, metric, " + O.r6("value") + " AS value FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS value FROM summary" for c in _SUMMARY)
    + " UNION ALL SELECT 'fold_' || Fold || '_train_r2', Train_R2 FROM fold_tbl"
    + " UNION ALL SELECT 'fold_' || Fold || '_cv_r2', CV_R2 FROM fold_tbl"
    + " UNION ALL SELECT 'fold_' || Fold || '_gap', Gap FROM fold_tbl"
    + " UNION ALL SELECT 'test_r2', value FROM test_r2) m")


@register("metrics_long", _METRICS_SQL)
def q_metrics(spark, sf):
    """(model, metric, value) long metrics table."""
    return round_doubles(_cv_group_mean(spark, sf).metrics)


# ---------------------------------------------------------------- S1-S4, S6-S8, P1, A3, U1

def _payload_json(time_arr, arrays: dict):
    """``{"hourly": {"time": [...], <var>: [...]}}`` as JSON text."""
    return F.to_json(F.struct(F.struct(time_arr.alias("time"),
                                       *[a.alias(v) for v, a in arrays.items()]).alias("hourly")))


def _defect_texts(variables: list[str]) -> tuple[list, object]:
    """(payload text per defect kind in ``ix % 16`` order 0..5, good text).

    Kinds: no ``hourly``, corrupt text, unequal lengths, bad time, empty
    arrays, missing variable.
    """
    h = F.col("hourly")
    t = h["time"]
    arrays = {v: h[v] for v in variables}
    first = variables[0]
    good = F.to_json(F.struct(h.alias("hourly")))
    shorter = dict(arrays)
    shorter[first] = F.slice(arrays[first], 1, F.greatest(F.size(arrays[first]) - 1, F.lit(0)))
    return [
        F.lit('{"error": true, "reason": "no data"}'),
        F.expr("substring(to_json(struct(hourly)), 1, length(to_json(struct(hourly))) - 5)"),
        _payload_json(t, shorter),
        _payload_json(F.transform(t, lambda x, i: F.when(i == 0, F.lit("not-a-time")).otherwise(x)),
                      arrays),
        _payload_json(F.array().cast("array<string>"),
                      {v: F.array().cast("array<double>") for v in variables}),
        _payload_json(t, {v: a for v, a in arrays.items() if v != variables[-1]}),
    ], good


def _land(spark, hourly, feed, variables, defects: bool = False) -> str:
    """Write the adapter's hourly rows as landed payloads; return the path.

    With ``defects``, the cities with ``ix % 16`` in 0..5 get one defect kind
    each (every payload of such a city); all rows are still written.
    """
    from airshed.session import scratch_path
    from airshed.sources.payload import to_payloads, write_landing
    p = to_payloads(hourly, variables)
    kinds, good = _defect_texts(variables)
    text = good
    if defects:
        ix = dim_city(spark, with_index=True).select("city", "ix")
        p = p.join(ix, "city")
        k = F.col("ix") % 16
        text = None
        for i, bad in enumerate(kinds):
            text = F.when(k == i, bad) if text is None else text.when(k == i, bad)
        text = text.otherwise(good)
    path = scratch_path(spark, f"landing-{feed}") + f"/feed={feed}"
    write_landing(p.select("city", text.alias("value")), path)
    return path


@register("src_aqi_payload", O.with_base(O.select_rounded(["time", "city", "pm10", "pm2_5"], "hourly_aqi")))
def q_src_aqi(spark, sf):
    """Landed AQI payloads -> hourly rows (city from the folder)."""
    from airshed.schemas import AQI_VARS
    from airshed.sources.payload import hourly_from_landing
    path = _land(spark, hourly_aqi(spark, sf), "aqi", AQI_VARS)
    rows, _ = hourly_from_landing(spark, path, "aqi")
    return round_doubles(rows)


_W = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "wind_direction_10m",
      "precipitation", "surface_pressure"]


@register("src_weather_payload", O.with_base(O.select_rounded(["time", "city", *_W], "hourly_weather")))
def q_src_weather(spark, sf):
    """Landed weather payloads -> hourly rows."""
    from airshed.schemas import WEATHER_VARS
    from airshed.sources.payload import hourly_from_landing
    path = _land(spark, hourly_weather(spark, sf), "weather", WEATHER_VARS)
    rows, _ = hourly_from_landing(spark, path, "weather")
    return round_doubles(rows)


@register("src_payload_reject", O.with_base(
    "SELECT 'aqi' AS feed, city, CASE ix % 16 WHEN 0 THEN 'no_hourly' WHEN 1 THEN 'corrupt' "
    "WHEN 2 THEN 'length_mismatch' WHEN 3 THEN 'bad_time' WHEN 4 THEN 'empty' "
    "ELSE 'missing_variable' END AS reason FROM dim_city "
    "WHERE ix % 16 < 6 AND city IN (SELECT city FROM hourly_aqi)"))
def q_src_reject(spark, sf):
    """S3: bad payloads (six kinds) -> reject table; one row per city."""
    from airshed.schemas import AQI_VARS
    from airshed.sources.payload import hourly_from_landing
    path = _land(spark, hourly_aqi(spark, sf), "aqi", AQI_VARS, defects=True)
    _, rej = hourly_from_landing(spark, path, "aqi")
    return rej


@register("src_payload_accepted", O.with_base(
    "SELECT city, count(*) AS n_hours FROM hourly_aqi a JOIN dim_city d USING (city) "
    "WHERE d.ix % 16 >= 6 GROUP BY city"))
def q_src_accepted(spark, sf):
    """S3: the cities with good payloads keep every hourly row."""
    from airshed.schemas import AQI_VARS
    from airshed.sources.payload import hourly_from_landing
    path = _land(spark, hourly_aqi(spark, sf), "aqi", AQI_VARS, defects=True)
    rows, _ = hourly_from_landing(spark, path, "aqi")
    return rows.groupBy("city").agg(F.count(F.lit(1)).alias("n_hours"))


@register("src_all_rejected", O.with_base(
    "SELECT time, city, pm10, pm2_5 FROM raw_aqi WHERE false"))
def q_src_all_rejected(spark, sf):
    """Every city's payload is bad -> an empty raw table that still has
    its full schema (the next stage can read it)."""
    from airshed.schemas import AQI_VARS
    from airshed.session import scratch_path
    from airshed.sources.payload import hourly_from_landing, to_payloads, write_landing
    p = to_payloads(hourly_aqi(spark, sf), AQI_VARS)
    path = scratch_path(spark, "landing-rejected") + "/feed=aqi"
    write_landing(p.select("city", F.lit('{"error": true}').alias("value")), path)
    rows, _ = hourly_from_landing(spark, path, "aqi")
    return stages.gather_aqi(rows)


@register("src_all_rejected_reasons", O.with_base(
    "SELECT DISTINCT 'aqi' AS feed, city, 'no_hourly' AS reason FROM hourly_aqi"))
def q_src_all_rejected_reasons(spark, sf):
    """The same landing's reject table names every city."""
    from airshed.schemas import AQI_VARS
    from airshed.session import scratch_path
    from airshed.sources.payload import hourly_from_landing, to_payloads, write_landing
    p = to_payloads(hourly_aqi(spark, sf), AQI_VARS)
    path = scratch_path(spark, "landing-rejected") + "/feed=aqi"
    write_landing(p.select("city", F.lit('{"error": true}').alias("value")), path)
    return hourly_from_landing(spark, path, "aqi")[1]


@register("src_date_range", O.with_base(O.select_rounded(
    ["time", "city", "pm10", "pm2_5"], "raw_aqi WHERE time >= TIMESTAMP '2024-02-10 00:00:00' "
    "AND time < TIMESTAMP '2024-09-21 00:00:00'")))
def q_src_dates(spark, sf):
    """Inclusive date range [2024-02-10, 2024-09-20] on the hourly stage
    (files picked by the landing manifest, then a pushed-down filter on the time)."""
    import datetime as dt

    from airshed.schemas import AQI_VARS
    from airshed.session import scratch_path
    from airshed.sources.payload import accepted, files_for, read_payloads, rejects, write_hourly, write_manifest
    landed = _land(spark, hourly_aqi(spark, sf), "aqi", AQI_VARS)
    stage = scratch_path(spark, "hourly-aqi")
    start, end, manifest = dt.date(2024, 2, 10), dt.date(2024, 9, 20), scratch_path(spark, "manifest")
    write_manifest(spark, landed, "aqi", manifest)
    files = files_for(spark, landed, manifest, start, end)
    write_hourly(read_payloads(spark, landed, AQI_VARS, files=files), "aqi", stage)
    rej = pinned(spark, rejects(spark, stage, "aqi"), "rejects-aqi")
    h = accepted(spark, stage, "aqi", rej, start, end)
    return round_doubles(stages.gather_aqi(h))


@register("dim_city", O.with_base(
    "SELECT d.city, d.lat, d.lon, d.region, count(*) AS n_hours "
    "FROM hourly_aqi h JOIN dim_city d ON h.city = d.city GROUP BY d.city, d.lat, d.lon, d.region"))
def q_dim_city(spark, sf):
    """The city dimension (48 fixed rows, broadcast) against the feed."""
    counts = hourly_aqi(spark, sf).groupBy("city").agg(F.count(F.lit(1)).alias("n_hours"))
    return counts.join(dim_city(spark), "city").select(
        "city", "lat", "lon", "region", "n_hours")


@register("src_city_semi", O.with_base(
    "SELECT city, count(*) AS n_hours FROM hourly_weather "
    "WHERE city IN (SELECT city FROM dim_city WHERE region NOT IN ('South', 'UT')) GROUP BY city"))
def q_src_semi(spark, sf):
    """Only listed cities, with a list that lacks two regions."""
    from airshed.sources.cities import CITIES, select_cities
    listed = [c for c, _lat, _lon, region in CITIES if region not in ("South", "UT")]
    return (select_cities(hourly_weather(spark, sf), listed)
            .groupBy("city").agg(F.count(F.lit(1)).alias("n_hours")))


@register("csv_roundtrip", O.with_base(O.select_rounded(MERGED_COLS, "merged")))
def q_csv(spark, sf):
    """Merged table -> CSV (header) -> read back with the schema."""
    from airshed.schemas import MERGED
    from airshed.session import scratch_path
    from airshed.sources.files import read_csv, write_csv
    path = scratch_path(spark, "csv-merged")
    write_csv(merged(spark, sf), path)
    return round_doubles(read_csv(spark, path, MERGED))


@register("parse_time", O.with_base(
    "SELECT time, city, time AS t_iso, time AS t_space, CAST(NULL AS TIMESTAMP) AS t_junk "
    "FROM hourly_aqi"))
def q_parse_time(spark, sf):
    """ISO 'T' text and space text parse; junk becomes NULL (no failure)."""
    from airshed.functions.calendar import parse_time
    h = hourly_aqi(spark, sf).select("time", "city")
    iso = F.date_format("time", "yyyy-MM-dd'T'HH:mm")
    return h.select("time", "city",
                    parse_time(iso).alias("t_iso"),
                    parse_time(F.col("time").cast("string")).alias("t_space"),
                    parse_time(F.concat(iso, F.lit("h"))).alias("t_junk"))


_STAGES_SQL = O.with_base(
    "SELECT 'hourly_aqi' AS stage, count(*) AS n_rows FROM hourly_aqi UNION ALL "
    "SELECT 'hourly_weather', count(*) FROM hourly_weather UNION ALL "
    "SELECT 'raw_aqi', count(*) FROM raw_aqi UNION ALL "
    "SELECT 'raw_weather', count(*) FROM raw_weather UNION ALL "
    "SELECT 'merged', count(*) FROM merged UNION ALL "
    "SELECT 'engineered', count(*) FROM engineered")


@register("stage_counts", _STAGES_SQL)
def q_stage_counts(spark, sf):
    """A3: rows of every stage's real output, W3 and W4 included.  (In the
    job runner the counts come from ``observe`` on each stage's write.)"""
    from airshed.operators.merge import union_frames
    outputs = {"hourly_aqi": hourly_aqi, "hourly_weather": hourly_weather, "raw_aqi": raw_aqi,
               "raw_weather": raw_weather, "merged": merged, "engineered": engineered}
    return union_frames([make(spark, sf).agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("n_rows"))
                         for stage, make in outputs.items()])


@register("union_cities", O.with_base(O.select_rounded(["time", "city", "pm10", "pm2_5"], "raw_aqi")))
def q_union(spark, sf):
    """Per-region 6-hour frames read from the city-partitioned landing
    zone (each branch prunes to its own city folders, so every file is read
    once overall), union-all by name = the full table."""
    from airshed.operators.merge import union_frames
    from airshed.schemas import AQI_VARS
    from airshed.sources.cities import CITIES
    from airshed.sources.payload import hourly_from_landing
    path = _land(spark, hourly_aqi(spark, sf), "aqi", AQI_VARS)
    regions: dict[str, list[str]] = {}
    for city, _lat, _lon, region in CITIES:
        regions.setdefault(region, []).append(city)
    rows, _ = hourly_from_landing(spark, path, "aqi")  # one reject pass
    # ``city`` is a partition column: each branch's filter prunes folders
    parts = [stages.gather_aqi(rows.where(F.col("city").isin(*regions[r]))) for r in sorted(regions)]
    return round_doubles(union_frames(parts))


# ---------------------------------------------------------------- M3, M5, M8, M9, M10, T1, S13

# These checks grow small ensembles, because their SQL replays every level of every tree.  The job's number and depth
# are its parameters (900 trees of depth 7 by default; README has figures), and gbt_cross_validate grows them all.
CHECK_TREES = 3
CHECK_BOOST = BoostParams(max_depth=3)


def _boosted(spark, sf, target: str = "pm2_5", numeric: list[str] = NUMERIC, categorical: list[str] = CATEGORICAL,
             boost: BoostParams = CHECK_BOOST, trees: int | None = CHECK_TREES, cross_validated: bool = False):
    """(node table, scored training rows, test rows) of the training job's own functions (trees None: as configured)."""
    from airshed.params import TrainParams
    from airshed.plans.train import boosted, split_features
    params = TrainParams(target=target, boost=boost)
    split = split_features(engineered(spark, sf), params)
    test = split.where(F.col("is_test")).drop("is_test")
    return *boosted(spark, split.where(~F.col("is_test")).drop("is_test"), params, trees, numeric, categorical,
                    cross_validated), test


def _boost_sql(select: str, **over) -> str:
    settings = {"features": FEATURES, "categorical": CATEGORICAL, "boost": CHECK_BOOST, "trees": CHECK_TREES,
                "models": [0]} | over
    return O.with_boost(select, **settings)


@register("bin_cut_points", _boost_sql(
    "SELECT feature, cast(row_number() OVER (PARTITION BY feature ORDER BY cut) AS integer) AS bin, "
    f"{O.r6('cut')} AS cut FROM cuts JOIN names ON names.f = cuts.f", trees=0))
def q_bins(spark, sf):
    """M3: cut points of every numeric feature from merged sketches (exact at this size), one pass."""
    from airshed.operators.binning import cut_points
    from airshed.params import TrainParams
    from airshed.plans.train import split_features
    params = TrainParams()
    rows = split_features(engineered(spark, sf), params).where(~F.col("is_test"))
    return round_doubles(cut_points(rows, NUMERIC, params.min_bins))


@register("gbt_fit_predict", _boost_sql(
    f"SELECT x.time, x.city, {O.r6('label')} AS label, {O.r6('p')} AS prediction FROM x JOIN pred ON pred.rid = x.rid WHERE is_test"))
def q_gbt(spark, sf):
    """M3 / M5 / M9: the held-out rows' predictions, from the node table."""
    from airshed.operators.trees import predict
    nodes, _, test = _boosted(spark, sf)
    return round_doubles(predict(test, nodes).select("time", "city", "label", "prediction"))


_STUMP = {"features": ["is_weekend"], "categorical": [], "boost": BoostParams(max_depth=1), "trees": 1}


def _stump(spark, sf, target: str) -> DataFrame:
    from airshed.operators.trees import predict
    nodes, _, test = _boosted(spark, sf, target, ["is_weekend"], [], _STUMP["boost"], 1)
    return round_doubles(predict(test, nodes).select("time", "city", "is_weekend", "prediction"))


def _stump_sql(target: str) -> str:
    return _boost_sql(f"SELECT x.time, x.city, f.is_weekend, {O.r6('p')} AS prediction FROM x JOIN pred ON pred.rid = x.rid "
                      "JOIN fm f ON f.time = x.time AND f.city = x.city WHERE x.is_test", target=target, **_STUMP)


@register("gbt_stump", _stump_sql("pm2_5"))
def q_gbt_stump(spark, sf):
    """M3 / M5 / M9: one tree of depth 1 on one feature, L1 and L2 included."""
    return _stump(spark, sf, "pm2_5")


@register("gbt_stump_pm10", _stump_sql("pm10"))
def q_gbt_stump_pm10(spark, sf):
    """The pm10 variants fit the same job on pm10."""
    return _stump(spark, sf, "pm10")


@register("importance_topk", _boost_sql(
    f"SELECT feature, {O.r6('coalesce(avg(gain), 0)')} AS importance, count(gain) AS splits "
    "FROM names LEFT JOIN nodes ON nodes.f = names.f GROUP BY feature"))
def q_importance(spark, sf):
    """Mean gain per split of every feature (top 40 of 22)."""
    from airshed.operators.trees import importance
    nodes, _, _ = _boosted(spark, sf)
    return round_doubles(importance(nodes, FEATURES, 40))


@register("model_save_load", _boost_sql(
    f"SELECT tree, cast(node AS integer) AS node, depth, feature, side = 1 AS default_left, {O.r6('gain')} AS gain, "
    f"cover, {O.r6('value')} AS value FROM nodes LEFT JOIN names ON names.f = nodes.f"))
def q_model_io(spark, sf):
    """The node table, saved as a version and loaded back."""
    from airshed.operators import trees
    from airshed.session import scratch_path
    nodes, _, _ = _boosted(spark, sf)
    path = scratch_path(spark, "model")
    trees.save(nodes, path, 1)
    loaded = trees.load(spark, path).where("tree >= 0")
    return round_doubles(loaded.select("tree", "node", "depth", "feature", "default_left", "gain", "cover", "value"))


_GBT_CV_SQL = O.with_whole_boost(f"""
, boosted_r2 AS (
  SELECT pred.m AS fold, x.fold = pred.m AS held,
         1 - sum((label - p) * (label - p)) / (var_pop(label) * count(*)) AS r2
  FROM x JOIN pred ON pred.rid = x.rid WHERE NOT is_test GROUP BY pred.m, x.fold = pred.m)
SELECT cast(fold AS integer) AS Fold, {O.r6('max(r2) FILTER (WHERE NOT held)')} AS Train_R2,
       {O.r6('max(r2) FILTER (WHERE held)')} AS CV_R2,
       {O.r6('max(r2) FILTER (WHERE NOT held) - max(r2) FILTER (WHERE held)')} AS Gap
FROM boosted_r2 GROUP BY fold""", FEATURES, CATEGORICAL, BoostParams(), [1, 2, 3, 4, 5])


@register("gbt_cross_validate", _GBT_CV_SQL)
def q_gbt_cv(spark, sf):
    """M4: k boosted models and the refit with every configured tree and level; their scores per fold."""
    from airshed.operators.crossval import fold_results
    from airshed.plans.train import fold_scores
    _, rows, _ = _boosted(spark, sf, boost=BoostParams(), trees=None, cross_validated=True)
    return round_doubles(fold_results(fold_scores(rows, 5)))
