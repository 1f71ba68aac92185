"""CSV import/export (parity with text hand-off) and Parquet stages.

Stages hand off as Parquet (typed, columnar, predicate/column pushdown); CSV
is offered for parity with the text files of the original job.  Missing input
paths raise ``AnalysisException`` (S9) -- they are not caught.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TIME_TEXT = "yyyy-MM-dd HH:mm:ss"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, no index; timestamps as ``yyyy-MM-dd HH:mm:ss``."""
    (df.write.mode(mode)
     .option("header", True)
     .option("timestampNTZFormat", TIME_TEXT)
     .option("timestampFormat", TIME_TEXT)
     .csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with a fixed schema; empty fields read as NULL."""
    return (spark.read.schema(schema)
            .option("header", True)
            .option("timestampNTZFormat", TIME_TEXT)
            .option("mode", "FAILFAST")
            .csv(path))


def write_stage(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Stage hand-off as Parquet."""
    df.write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int,
                   mode: str = "overwrite") -> None:
    """Stage hand-off as a bucketed, sorted external table: a later join on
    ``keys`` between tables with the same bucket count reads co-located
    buckets with no exchange (and no sort)."""
    (df.write.mode(mode)
     .bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path)
     .saveAsTable(table))


def read_bucketed(spark: SparkSession, table: str, path: str, schema: T.StructType, keys: list[str],
                  buckets: int) -> DataFrame:
    """A bucketed stage by name; registered from its folder and bucket spec
    when this session's catalog does not know it (another process wrote it)."""
    if not spark.catalog.tableExists(table):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        by = ", ".join(keys)
        spark.sql(f"CREATE TABLE {table} ({cols}) USING parquet LOCATION '{path}' "
                  f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS")
    return spark.table(table)


def read_stage(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No city succeeded -> an empty table that still has the schema."""
    return spark.createDataFrame([], schema)
