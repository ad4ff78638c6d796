"""Band joins on coordinates, as equality of grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_cell(df: DataFrame, lat: str, lon: str, per_degree: float) -> DataFrame:
    return df.withColumn("_gy", F.floor((F.col(lat) + 90) * per_degree)).withColumn("_gx", F.floor((F.col(lon) + 180) * per_degree))


def grid_join(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], per_degree: float, residual: Column, equal: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Pairs in the same or a neighbouring cell that fulfil `residual`. The left side is copied to its nine cells; cells, and the columns in
    `equal`, are an equi-join, which spreads over the cluster and which adaptive execution can split where a cell is crowded."""
    around = F.expr("explode(flatten(transform(sequence(-1, 1), y -> transform(sequence(-1, 1), x -> struct(_gy + y AS gy, _gx + x AS gx)))))")
    near = with_cell(left, *left_at, per_degree).withColumn("_c", around).drop("_gy", "_gx").select("*", F.col("_c.gy").alias("_gy"), F.col("_c.gx").alias("_gx")).drop("_c")
    there = with_cell(right, *right_at, per_degree).withColumnsRenamed({"_gy": "_hy", "_gx": "_hx"})
    on = (F.col("_gy") == F.col("_hy")) & (F.col("_gx") == F.col("_hx"))
    for a, b in equal:
        on = on & (F.col(a) == F.col(b))
    return near.join(there, on & residual).drop("_gy", "_gx", "_hy", "_hx")
