"""Connected components of a link table, as grouped minima and joins.

Alternating large-star and small-star steps: every node points its neighbours
at the smallest node it knows.  Stars collapse in one or two rounds, any graph
in O(log^2 n); the table never grows.  One aggregate tells when only stars are
left.  A node with very many links is reduced inside each task before the
shuffle, and its links are joined to one row, so adaptive execution can split
them.  Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed.llm.tables import kept


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # as many rows as links; repeats go in the small-star step
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Expects u > v on every edge."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Do all links point from a node with this one link to a node that points nowhere?  Expects distinct links."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not nodes.agg(F.count_if((F.col("out") > 1) | (F.col("out") > 0) & (F.col("into") > 0)).alias("n")).first()["n"]


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); the label is the smallest node of its component.

    Null ends and loops are ignored; nodes without a link are not returned.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"),
                                         F.least("a", "b").cast("long").alias("v")).distinct()
    edges = kept(spark, edges, "links")
    while not _stars(edges):
        edges = kept(spark, _small_star(_large_star(edges)), "links")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def merged(spark: SparkSession, label: DataFrame, links: DataFrame) -> DataFrame | None:
    """``label`` (node, label) of :func:`components` with ``links`` (a, b) added; None if they merge no classes.

    Only links between classes are followed, from label to label; nodes that ``label`` lacks are their own class.
    """
    ends = (links.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
            .join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
            .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    across = kept(spark, ends.where("a <> b").distinct(), "merges")
    if across.isEmpty():
        return None
    roots = kept(spark, components(spark, across), "roots")
    moved = (label.join(roots.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
             .select("node", F.coalesce("to", "label").alias("label")))
    return kept(spark, moved.union(roots.join(label.select("node"), "node", "left_anti").select("node", "label")), "classes")
