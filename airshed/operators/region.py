"""City -> region lookup with an eager completeness check."""

from __future__ import annotations

from pyspark.sql import DataFrame


class RegionMappingError(ValueError):
    pass


def cities_without_region(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Distinct cities of ``df`` absent from the dimension.

    One left-anti join whose strategy the planner picks by the dimension's
    size.  ``distinct`` is partially aggregated first, so a hot city costs one
    row per partition; a NULL city counts as missing.
    """
    return df.select("city").distinct().join(dim.select("city"), "city", "left_anti")


def check_regions(df: DataFrame, dim: DataFrame) -> None:
    """Fail, naming every city that has no region.

    Eager on purpose: a lazy guard inside the plan is pruned when the region
    column is not selected downstream.
    """
    missing = sorted((r["city"] for r in cities_without_region(df, dim).collect()), key=lambda c: (c is None, c or ""))
    if missing:
        raise RegionMappingError(f"Region mapping incomplete; missing region for: {missing}")


def add_region(df: DataFrame, dim: DataFrame, check: bool = True) -> DataFrame:
    """Left lookup join of ``region`` (the dimension has one row per city)."""
    if check:
        check_regions(df, dim)
    return df.join(dim.select("city", "region"), "city", "left").select(*df.columns, "region")
