"""Groupings by sorting, slicing and grid cells. Each gives ``problem_id, point_idx, label``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_count(n: Column, per_group: int = 12, least: int = 4) -> Column:
    """Automatic number of groups."""
    return F.greatest(F.lit(least), F.floor(n / per_group).cast("int"))


def clamp_groups(n: Column, k: int, least: int, most: int) -> Column:
    """(k, min, max) that fit n points."""
    lo = max(1, least)
    return F.struct(F.greatest(F.lit(1), F.least(F.lit(k), F.floor(n / lo).cast("int"))).alias("k"), F.lit(lo).alias("least"), F.lit(max(lo, most)).alias("most"))


def _sliced(points: DataFrame, axis: Column, groups: Column) -> DataFrame:
    by = Window.partitionBy("problem_id").orderBy(axis, "point_idx")
    n = F.count(F.lit(1)).over(Window.partitionBy("problem_id"))
    rows = points.select("problem_id", "point_idx", F.row_number().over(by).alias("_r"), n.alias("_n"))
    chunk = F.ceil(F.col("_n") / groups)
    return rows.select("problem_id", "point_idx", F.floor((F.col("_r") - 1) / chunk).cast("int").alias("label"))


def fence(points: DataFrame, groups: int) -> DataFrame:
    """Equal slices from west to east."""
    return _sliced(points, F.col("lng"), F.lit(groups))


def river(points: DataFrame, most: int, axis: str = "lng") -> DataFrame:
    """As few equal slices along an axis as keep each within ``most`` points."""
    return _sliced(points, F.col(axis), F.ceil(F.col("_n") / most))


def grid(points: DataFrame, cell_km: float = 5.0) -> DataFrame:
    """Cells of ``cell_km``, numbered from the south-west row by row."""
    mean = Window.partitionBy("problem_id")
    at = points.withColumn("_lat", F.avg("lat").over(mean)).withColumns({"_y": F.min("lat").over(mean), "_x": F.min("lng").over(mean)})
    row = F.floor((F.col("lat") - F.col("_y")) / (cell_km / 111.0))
    col = F.floor((F.col("lng") - F.col("_x")) / (F.lit(cell_km) / (111.0 * F.cos(F.radians("_lat")))))
    cells = at.select("problem_id", "point_idx", row.alias("r"), col.alias("c"))
    order = Window.partitionBy("problem_id").orderBy("r", "c")
    return cells.select("problem_id", "point_idx", (F.dense_rank().over(order) - 1).cast("int").alias("label"))
