"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import stored


def _stars(edges: DataFrame) -> DataFrame:
    """Large star: every greater neighbour of a node hangs on the least of the node and all
    its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    return (
        both.join(least, "a").filter(F.col("b") > F.col("a"))
        .select(F.col("_m").alias("a"), "b").filter("a <> b").distinct()
    )


def _small_stars(edges: DataFrame) -> DataFrame:
    """Small star: a node and its smaller neighbours hang on the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("_m"))
    joined = edges.join(least, "b")
    others = joined.select(F.col("_m").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("_m").alias("a"), "b")
    return others.unionByName(own).filter("a <> b").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node is either a center or hangs on a single one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("center"), F.lit(0).alias("leaf")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("center"), F.lit(1).alias("leaf"))
    )
    mixed = ends.groupBy("node").agg(F.max("center").alias("center"), F.sum("leaf").alias("leaves"))
    return mixed.filter("leaves > 1 OR (center = 1 AND leaves = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes that have an edge; the label is the least node.

    `edges` has two columns a, b of numbers; loops and repeats do no harm. Alternating stars
    need about log(n) rounds, and each round is a few aggregates and joins; the edges are
    stored after each, so nothing grows with the rounds.
    """
    now = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = stored(now.distinct(), "edges")
    while not _is_stars(now):
        now = stored(_small_stars(_stars(now)), "edges")
    labels = now.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return labels.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
