"""Landed hourly JSON payloads -> hourly rows.

Landing layout: ``<landing>/feed=<aqi|weather>/city=<city name>/*`` with one
JSON payload ``{"hourly": {"time": [...], <var>: [...], ...}}`` per line
(``multiline=True`` for one pretty-printed payload per file).  The city comes
from the folder (partition discovery), as in the request per city.

A payload is rejected -- and with it its whole city for that feed, as a failed
request drops the city -- when it is corrupt, has no ``hourly`` object, lacks
a variable array, has empty arrays, has arrays of unequal length, or holds a
time text that does not parse.  The other cities go on.

The JSON is parsed once, into an hourly Parquet stage (see
:func:`write_hourly`): a generator inside the scan task, no shuffle, one file a
task, sorted by time.  A bad payload is one row that carries its reason and no
time.  The reject table and the date range are filters on that stage, which
the row groups' least and greatest times prune, and rejected cities are removed
by one null-safe anti join.

Pruning before parsing: a *manifest* (:func:`write_manifest`) says of every
landed file how many hours it holds and from when to when.  With it a date
range opens only the files that it needs, files that hold a bad payload (they
decide about their cities), and files that the manifest doesn't know.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airshed.functions.calendar import parse_time
from airshed.functions.nan import nan_to_null
from airshed.schemas import AQI_VARS, WEATHER_VARS, payload_schema
from airshed.session import pinned, scratch_path

FEEDS = {"aqi": AQI_VARS, "weather": WEATHER_VARS}

# Reject reasons.
CORRUPT = "corrupt"
NO_HOURLY = "no_hourly"
MISSING_VARIABLE = "missing_variable"
EMPTY = "empty"
LENGTH_MISMATCH = "length_mismatch"
BAD_TIME = "bad_time"


def read_payloads(spark: SparkSession, path: str, variables: list[str],
                  multiline: bool = False, files: list[str] | None = None) -> DataFrame:
    """Scan landed payloads (all, or the ``files`` named) with a fixed schema (PERMISSIVE, corrupt text kept)."""
    if files is not None and not files:
        return spark.createDataFrame([], payload_schema(variables).add("city", T.StringType()))
    return (spark.read.schema(payload_schema(variables))
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("multiLine", str(multiline).lower())
            .option("basePath", path)
            .json(path if files is None else files))


MANIFEST = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("city", T.StringType()), T.StructField("bytes", T.LongType()),
    T.StructField("first", T.TimestampNTZType()), T.StructField("last", T.TimestampNTZType()),
    T.StructField("rows", T.LongType()), T.StructField("bad", T.LongType()),
])


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, bytes) of every landed file (``file``: its address as scans report it); a listing, no file is opened."""
    return (spark.read.format("binaryFile").option("basePath", path).option("recursiveFileLookup", "true").load(path)
            .select("path", F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes")))


def write_manifest(spark: SparkSession, path: str, feed: str, manifest: str, multiline: bool = False) -> None:
    """Describes the landed files of one feed that the manifest at ``manifest`` doesn't know yet (new or changed)."""
    known = _manifest(spark, manifest)
    new = landed_files(spark, path).join(known.select("file", "bytes"), ["file", "bytes"], "left_anti")
    listed = [r["path"] for r in new.select("path").collect()]  # the driver lists the files of a scan in any case
    if not listed:
        return
    rows = read_payloads(spark, path, FEEDS[feed], multiline, listed) \
        .withColumns({"file": F.col("_metadata.file_path"), "bytes": F.col("_metadata.file_size")})
    times = F.transform(F.when(reject_reason(FEEDS[feed]).isNull(), F.col("hourly.time")), parse_time)
    per = (rows.select("file", "bytes", "city", times.alias("t"), reject_reason(FEEDS[feed]).isNotNull().cast("long").alias("bad"))
           .groupBy("file", "bytes", "city").agg(F.min(F.array_min("t")).alias("first"), F.max(F.array_max("t")).alias("last"),
                                        F.sum(F.coalesce(F.size("t"), F.lit(0)).cast("long")).alias("rows"),
                                        F.sum("bad").alias("bad")))
    out = per.select(*[F.col(f.name).cast(f.dataType) for f in MANIFEST.fields])
    out.write.mode("append").parquet(manifest)


def _manifest(spark: SparkSession, manifest: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(manifest)


def files_for(spark: SparkSession, path: str, manifest: str, start: dt.date, end: dt.date) -> list[str]:
    """Landed files that hours of the inclusive range need: those whose times meet it, those that hold a
    bad payload, and those that the manifest doesn't describe (new, or of another size)."""
    known = _manifest(spark, manifest)
    lo, hi = _bounds(start, end)
    apart = known.where((F.col("bad") == 0) & (F.col("first").isNull() | (F.col("last") < lo) | (F.col("first") >= hi)))
    return [r["path"] for r in landed_files(spark, path)
            .join(apart.select("file", "bytes"), ["file", "bytes"], "left_anti").orderBy("path").collect()]


def reject_reason(variables: list[str]) -> Column:
    h = F.col("hourly")
    t = h["time"]
    missing = t.isNull()
    for v in variables:
        missing = missing | h[v].isNull()
    unequal = F.lit(False)
    for v in variables:
        unequal = unequal | (F.size(h[v]) != F.size(t))
    bad_time = F.exists(t, lambda x: x.isNotNull() & parse_time(x).isNull())
    return (F.when(F.col("_corrupt_record").isNotNull(), CORRUPT)
            .when(h.isNull(), NO_HOURLY)
            .when(missing, MISSING_VARIABLE)
            .when(F.size(t) == 0, EMPTY)
            .when(unequal, LENGTH_MISMATCH)
            .when(bad_time, BAD_TIME))


def parsed(payloads: DataFrame, variables: list[str]) -> DataFrame:
    """(time, <variables>, reason, city, month): one row per hour of a good
    payload, one row with a reason (and nothing else) per bad one."""
    hour = "struct<" + ", ".join(["time:string", *[f"{v}:double" for v in variables]]) + ">"
    zipped = F.arrays_zip(*[F.col(f"hourly.{v}") for v in ["time", *variables]])
    none = F.array(F.lit(None).cast(hour))
    rows = (payloads.withColumn("reason", reject_reason(variables))
            .select("city", "reason", F.explode(F.when(F.col("reason").isNull(), zipped).otherwise(none)).alias("h")))
    # arrays_zip names fields after the source fields: time, <var>...
    out = rows.select(parse_time(F.col("h.time")).alias("time"), *[F.col(f"h.{v}") for v in variables],
                      "reason", "city")
    return nan_to_null(out, variables).where(F.col("time").isNotNull() | F.col("reason").isNotNull())


def write_hourly(payloads: DataFrame, feed: str, path: str) -> None:
    """The hourly stage of one feed: one Parquet file a task, in time order (bad payloads first)."""
    parsed(payloads, FEEDS[feed]).sortWithinPartitions("time").write.mode("overwrite").parquet(path)


def hourly_schema(variables: list[str]) -> T.StructType:
    return T.StructType([T.StructField("time", T.TimestampNTZType()), *[T.StructField(v, T.DoubleType()) for v in variables],
                         T.StructField("reason", T.StringType()), T.StructField("city", T.StringType())])


def rejects(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """(feed, city, reason): one row per rejected city and reason of an hourly stage."""
    stage = spark.read.schema(hourly_schema(FEEDS[feed])).parquet(path)
    return (stage.where("time IS NULL AND reason IS NOT NULL")
            .select(F.lit(feed).alias("feed"), "city", "reason").distinct())


def accepted(spark: SparkSession, path: str, feed: str, rejected: DataFrame, start: dt.date | None = None,
             end: dt.date | None = None) -> DataFrame:
    """(time, city, <variables>) of the cities without a rejected payload.

    ``rejected`` should be a written table, so that the planner knows its size
    (one row per rejected city).  A NULL city is a city like any other.
    """
    variables = FEEDS[feed]
    stage = spark.read.schema(hourly_schema(variables)).parquet(path).where("time IS NOT NULL")
    if start is not None and end is not None:
        stage = restrict_dates(stage, start, end)
    bad = rejected.select(F.col("city").alias("_city"))
    return (stage.join(bad, F.col("city").eqNullSafe(F.col("_city")), "left_anti")
            .select("time", "city", *variables))


def hourly_from_landing(spark: SparkSession, path: str, feed: str, multiline: bool = False,
                        payloads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hourly rows of accepted cities, reject table) for one feed; the hourly
    stage and the reject table are written to the shared folder."""
    if payloads is None:
        payloads = read_payloads(spark, path, FEEDS[feed], multiline)
    stage = scratch_path(spark, f"hourly-{feed}")
    write_hourly(payloads, feed, stage)
    rej = pinned(spark, rejects(spark, stage, feed), f"rejects-{feed}")
    return accepted(spark, stage, feed, rej), rej


def _bounds(start: dt.date, end: dt.date) -> tuple[Column, Column]:
    # text -> TIMESTAMP_NTZ is zone-free (a Python datetime literal would be
    # a zoned timestamp and shift with the session time zone)
    return (F.lit(f"{start.isoformat()} 00:00:00").cast("timestamp_ntz"),
            F.lit(f"{(end + dt.timedelta(days=1)).isoformat()} 00:00:00").cast("timestamp_ntz"))


def restrict_dates(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """``start <= time < end + 1 day`` (inclusive dates; pushed to Parquet
    scans as a range filter)."""
    lo, hi = _bounds(start, end)
    return df.where((F.col("time") >= lo) & (F.col("time") < hi))


# ---------------------------------------------------------------- landing writer

TIME_TEXT = "yyyy-MM-dd'T'HH:mm"


def to_payloads(hourly: DataFrame, variables: list[str]) -> DataFrame:
    """Hourly rows -> (city, hourly struct of parallel arrays).

    One payload per (city, month, input partition), as the service's requests
    land: a group never exceeds one
    input split, however many rows a city or hour holds.  Structs are
    collected (not bare columns, whose NULLs ``collect_list`` would drop) and
    split into parallel arrays.
    """
    rec = F.struct(F.date_format("time", TIME_TEXT).alias("time"), *[F.col(v) for v in variables])
    grouped = (hourly
               .withColumn("_part", F.spark_partition_id())
               .groupBy("city", F.trunc("time", "month").alias("_month"), "_part")
               .agg(F.array_sort(F.collect_list(rec)).alias("_recs")))
    # ``_recs.<field>`` on an array of structs is the array of that field.
    arrays = [F.col(f"_recs.{f}").alias(f) for f in ["time", *variables]]
    return grouped.select("city", F.struct(*arrays).alias("hourly"))


def write_landing(payloads: DataFrame, path: str, text_col: str = "value") -> None:
    """Write ``(city, <text_col>)`` JSON text as ``city=<name>/`` folders."""
    (payloads.select("city", F.col(text_col).alias("value"))
     .write.mode("overwrite").partitionBy("city").text(path))
