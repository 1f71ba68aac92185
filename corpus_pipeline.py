"""Corpus pipeline: documents to a training mix, in five stages.

Each stage works on all rows that its predecessor kept; :func:`run` writes
every stage's result as Parquet in the shared folder and reads it again, so a
lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed.llm import decontam, mixing, neardup, quality, spans
from airshed.llm.tables import kept

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (the smallest id)."""
    return neardup.keep_first(spark, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated sentence spans go; a document left without any word goes too."""
    cleaned = spans.remove_repeats(docs)
    emptied = (F.col("n_sentences") > 0) & (F.col("n_removed") == F.col("n_sentences"))
    stay = cleaned.where(~emptied)
    if "n_chars" in docs.columns:
        stay = stay.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return stay.select(*[f"`{c}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item."""
    found = decontam.find(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), exact=True)
    return found.where(F.size("spans") == 0).select(*[f"`{c}`" for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, with its output shard, shuffled within shards."""
    return mixing.deal(mixing.mix(spark, docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("source mix", source_mix),
]

#: Near-duplicate classes and hash-drawn copies have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(spark, stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
