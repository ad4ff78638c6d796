"""Splitting places into tiles of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_tiles(places: DataFrame, lat: str, lon: str, target: int, first: float = 32.0, depth: int = 6) -> DataFrame:
    """level, ty, tx, n: square tiles of `first` degrees, halved while they hold more than `target` places, `depth` levels at most.

    All levels' counts come from one pass, each place giving a row to each level; a tile stays if it holds few enough (or is deepest) and
    every tile around it on coarser levels holds too many."""
    levels = [first / (1 << k) for k in range(depth + 1)]
    at = [F.struct(F.lit(k).alias("level"), F.floor((F.col(lat) + 90) / d).alias("ty"), F.floor((F.col(lon) + 180) / d).alias("tx")) for k, d in enumerate(levels)]
    counts = places.select(F.explode(F.array(*at)).alias("t")).groupBy("t").agg(F.count("*").alias("n")).select("t.level", "t.ty", "t.tx", "n")
    kept = counts.where((F.col("n") <= target) | (F.col("level") == depth))
    full = counts.where(F.col("n") > target).select(F.col("level").alias("fl"), F.col("ty").alias("fy"), F.col("tx").alias("fx"))
    up = kept.where("level > 0").select("*", (F.col("level") - 1).alias("fl"), F.floor(F.col("ty") / 2).alias("fy"), F.floor(F.col("tx") / 2).alias("fx"))
    return up.join(full, ["fl", "fy", "fx"], "left_semi").select("level", "ty", "tx", "n").unionByName(kept.where("level = 0"))


def routing_directory(shards: DataFrame, key: str, bounds: tuple[str, str, str, str], degrees: float = 1.0) -> DataFrame:
    """tile_y, tile_x and the sorted keys of the shards whose box (south, north, west, east) meets the tile."""
    s, n, w, e = (F.col(b) for b in bounds)

    def span(a, b, base):
        return F.sequence(F.floor((a + base) / degrees), F.floor((b + base) / degrees))

    rows = shards.select(key, F.explode(span(s, n, 90)).alias("tile_y"), w.alias("_w"), e.alias("_e")).select(key, "tile_y", F.explode(span(F.col("_w"), F.col("_e"), 180)).alias("tile_x"))
    return rows.groupBy("tile_y", "tile_x").agg(F.array_sort(F.collect_set(key)).alias("keys"))
