"""Connected components of a graph given as a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(links: DataFrame, small: bool) -> DataFrame:
    """links (a, b) with a > b. Large star: each node's larger neighbours go to its least neighbour; small star: its smaller ones and itself do.
    The least neighbour is a partial aggregate and comes back by a join, so a node with very many links is no task's burden."""
    both = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if small:
        pairs = joined.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    else:
        pairs = joined.where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    return pairs.where("x > y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its least node), for the nodes of links (a, b). Null ends and self links are left out; no links, no rows."""
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = scratch.keep(now, "links"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = mark
        now = scratch.keep(_star(_star(now, False), True), "stars")
