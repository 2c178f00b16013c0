"""Connected components of links between integers, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import join_groups, measured, measured_groups, stored


def _step(links: DataFrame, both_ways: bool) -> DataFrame:
    """Every node's neighbours (its larger ones, or it and its smaller ones) are linked to the smallest of them."""
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    # a: the node, b: a neighbour; smaller neighbours only, unless both ways
    seen = links.union(turned) if both_ways else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least, sizes = measured_groups(seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), "n")
    met = join_groups(seen, least, ["a"], "n", F.col("b"), sizes)
    if both_ways:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node but the roots themselves.

    ``links`` has two long columns, ``a`` and ``b``; direction, repeats and loops do not matter. Sums of a star are
    combined before they move, and a node with very many links is dealt out over tasks.
    """
    links = stored(links.where("a <> b").select("a", "b").distinct())
    mark = None
    while True:
        links = _step(stored(_step(links, True)), False)
        links, now = measured(links, n=F.count(F.lit(1)), h=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
