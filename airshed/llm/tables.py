"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airshed.session import scratch_path


def kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read again.

    Cuts lineage: a lost executor costs a task of the step that reads it,
    never the steps before.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
