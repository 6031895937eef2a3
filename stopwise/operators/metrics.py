"""Figures of groups and plans, and comparisons of plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, degrees_apart, haversine_km, lens_area, planar_km
from . import shared
from .shapes import diameters


def sizes(labels: DataFrame) -> DataFrame:
    """Number of groups and mean, least, most, standard deviation and variation of their sizes."""
    n = labels.groupBy("problem_id", "label").agg(F.count(F.lit(1)).alias("n"))
    std, mean = F.stddev_pop("n"), F.avg("n")
    return n.groupBy("problem_id").agg(F.count(F.lit(1)).alias("groups"), F.round(mean, 6).alias("mean_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.round(std, 6).alias("std_size"), F.round(std / mean, 6).alias("variation"))


def spread(points: DataFrame, labels: DataFrame) -> DataFrame:
    """``problem_id, label, max_km``: each group's largest distance, 0 for a single point; see :func:`.shapes.diameters`."""
    far = diameters(points, labels)
    return labels.select("problem_id", "label").distinct().join(far, ["problem_id", "label"], "left").withColumn("max_km", F.coalesce("max_km", F.lit(0.0)))


def _to_box(lat: Column, lng: Column, box: str) -> Column:
    """A distance in km that no point of the box of degrees ``box`` comes below, seen from (lat, lng)."""
    north = F.greatest(F.lit(0.0), lat - F.col(f"{box}.n"), F.col(f"{box}.s") - lat)
    round_ = lambda c: F.pmod(c, F.lit(360.0))
    inside = (lng >= F.col(f"{box}.w")) & (lng <= F.col(f"{box}.e"))
    east = F.when(inside, 0.0).otherwise(F.least(round_(F.col(f"{box}.w") - lng), round_(lng - F.col(f"{box}.e"))))
    # to the meridian of the box's nearer side, where the way to it is under a quarter of the globe
    across = F.when(east < 90.0, F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(east)))).otherwise(F.lit(0.0))
    return F.lit(EARTH_KM) * F.greatest(F.radians(north), across) - 1e-5


def gaps(points: DataFrame, labels: DataFrame) -> DataFrame:
    """``problem_id, label_a, label_b, min_km``: the least distance of each pair of groups.

    A pair of points gives a distance that is reached: the point of one group nearest to the other's box, the other's point
    nearest to that, and back. Only points that are as near to the other group's box are left; these meet in grid cells
    of that width. So a point meets each group once, and points of two groups meet only along their border.
    """
    rows = points.select("problem_id", "point_idx", "lat", "lng").join(labels.select("problem_id", "point_idx", "label"), ["problem_id", "point_idx"])
    rows = shared.cut(rows, "labelled")
    box = F.struct(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"))
    boxes = rows.groupBy("problem_id", "label").agg(box.alias("box"))
    a, b = (boxes.select("problem_id", F.col("label").alias(f"label_{k}"), F.col("box").alias(f"box_{k}")) for k in "ab")
    both = shared.cut(a.join(b, "problem_id").filter("label_a < label_b"), "boxes")
    pair = ["problem_id", "label_a", "label_b"]
    of = lambda side: rows.withColumnRenamed("label", f"label_{side}").select("problem_id", f"label_{side}", "point_idx", "lat", "lng")
    best = lambda km: F.min(F.struct(km.alias("km"), "point_idx", "lat", "lng"))
    met = both.join(of("a"), ["problem_id", "label_a"]).groupBy(*pair).agg(best(_to_box(F.col("lat"), F.col("lng"), "box_b")).alias("at"))
    for side in "ba":
        far = haversine_km(F.col("lat"), F.col("lng"), F.col("at.lat"), F.col("at.lng"))
        met = met.join(of(side), ["problem_id", f"label_{side}"]).groupBy(*pair).agg(best(far).alias("at"))
    bound = both.join(met.select(*pair, F.col("at.km").alias("bound")), pair)
    bound = shared.cut(bound.withColumn("far", F.greatest(*[F.abs(F.col(f"box_{k}.{e}")) for k in "ab" for e in "sn"])), "bounds")

    def border(side: str, other: str) -> DataFrame:
        near = bound.join(of(side), ["problem_id", f"label_{side}"]).filter(_to_box(F.col("lat"), F.col("lng"), f"box_{other}") <= F.col("bound"))
        lng = F.col("lng")
        if side == "b":  # it also stands beyond the antimeridian
            near = near.withColumn("lng", F.explode(F.when(lng > 90, F.array(lng, lng - 360)).when(lng < -90, F.array(lng, lng + 360)).otherwise(F.array(lng))))
        step = F.greatest(F.col("bound"), F.lit(0.001)) / 111.0
        wide = step / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.col("far") + step))))
        cells = {"cy": F.floor(F.col("lat") / step), "cx": F.floor(F.col("lng") / wide)}
        return near.withColumns(cells).select(*pair, F.col("lat").alias(f"lat_{side}"), F.col("lng").alias(f"lng_{side}"), "cy", "cx")

    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    left = border("a", "b").withColumn("s", around).withColumns({"cy": F.col("cy") + F.col("s.dy"), "cx": F.col("cx") + F.col("s.dx")}).drop("s")
    met = left.join(border("b", "a"), [*pair, "cy", "cx"])
    return met.groupBy(*pair).agg(F.min(haversine_km(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"))).alias("min_km"))


def quality(points: DataFrame, labels: DataFrame, overlap_km: float = 1.0) -> DataFrame:
    """Spread, gaps, their ratio, and whether two groups come nearer than ``overlap_km``."""
    inside = spread(points, labels).groupBy("problem_id").agg(F.round(F.avg("max_km"), 6).alias("mean_spread"), F.max("max_km").alias("max_spread"))
    between = gaps(points, labels).groupBy("problem_id").agg(F.round(F.avg("min_km"), 6).alias("mean_gap"), F.min("min_km").alias("min_gap"), F.coalesce(F.bool_or(F.col("min_km") < overlap_km), F.lit(False)).alias("has_overlap"))
    out = sizes(labels).join(inside, "problem_id").join(between, "problem_id", "left")
    ratio = F.when(F.col("mean_spread") > 0, F.round(F.col("mean_gap") / F.col("mean_spread"), 6))
    return out.withColumn("separation", ratio).withColumn("has_overlap", F.coalesce("has_overlap", F.lit(False)))


def longitude_overlap(points: DataFrame, labels: DataFrame) -> DataFrame:
    """``problem_id, lng_overlap``: whether the longitude intervals of two groups meet; by running maxima, not by pairs."""
    span = points.join(labels, ["problem_id", "point_idx"]).groupBy("problem_id", "label").agg(F.min("lng").alias("lo"), F.max("lng").alias("hi"))
    before = Window.partitionBy("problem_id").orderBy("lo", "label").rowsBetween(Window.unboundedPreceding, -1)
    return span.withColumn("reach", F.max("hi").over(before)).groupBy("problem_id").agg(F.coalesce(F.bool_or(F.col("lo") < F.col("reach")), F.lit(False)).alias("lng_overlap"))


#: Weights of the scores (spread, separation, size term, overlap) and which size term they take.
SCORES = {"balanced": (5, 20, 30, 20, "variation"), "practical": (3, 10, 20, 30, "variation"), "capped": (5, 10, 5, 50, "std_size"), "fence": (2, 10, 5, 20, "std_size")}


def score(kind: str, spread_km: Column, separation: Column, size_term: Column, overlaps: Column) -> Column:
    """100 less the weighted faults, plus separation; 0 at least."""
    a, b, c, d, _ = SCORES[kind]
    raw = 100 - a * spread_km + b * F.coalesce(separation, F.lit(0.0)) - c * size_term - F.when(overlaps, d).otherwise(0)
    return F.greatest(F.lit(0.0), F.round(raw, 6))


def ranked(scores: DataFrame) -> DataFrame:
    """Adds ``rank`` by ``score``, ties in the order of ``ordinal``."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("problem_id").orderBy(F.col("score").desc(), "ordinal")))


def violations(labels: DataFrame, least: int, most: int) -> DataFrame:
    n = labels.groupBy("problem_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("problem_id").agg(F.bool_or(F.col("n") > most).alias("over"), F.bool_or(F.col("n") < least).alias("under"))


def circles(points: DataFrame, labels: DataFrame) -> DataFrame:
    """``problem_id, label, lat, lng, r``: each group's mean and its farthest member from it, in degrees."""
    rows = points.select("problem_id", "point_idx", "lat", "lng").join(labels, ["problem_id", "point_idx"])
    mean = rows.groupBy("problem_id", "label").agg(F.avg("lat").alias("c_lat"), F.avg("lng").alias("c_lng"))
    far = rows.join(mean, ["problem_id", "label"]).withColumn("d", degrees_apart(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")))
    out = far.groupBy("problem_id", "label").agg(F.first("c_lat").alias("lat"), F.first("c_lng").alias("lng"), F.max("d").alias("r"))
    return out.select("problem_id", "label", *[F.round(c, 9).alias(c) for c in ("lat", "lng", "r")])


def circle_pairs(found: DataFrame) -> DataFrame:
    """Each pair of circles of a problem: distance, depth of overlap, shared area, separation term."""
    a, b = (found.select("problem_id", *[F.col(c).alias(f"{c}_{k}") for c in ("label", "lat", "lng", "r")]) for k in "ab")
    rows = a.join(b, "problem_id").filter("label_a < label_b")
    d = degrees_apart(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"))
    rows = rows.withColumn("d", d)
    total = F.col("r_a") + F.col("r_b")
    return rows.select("problem_id", "label_a", "label_b", "d", F.greatest(F.lit(0.0), total - F.col("d")).alias("depth"), lens_area(F.col("d"), F.col("r_a"), F.col("r_b")).alias("shared"), F.when(F.col("d") > 0, total / F.col("d")).otherwise(0.0).alias("term"))


def circle_cost(found: DataFrame, penalty: float = 5.0, weight: float = 0.8, squared: bool = True) -> DataFrame:
    """``area, overlap, depth, separation, cost`` of a problem's circles."""
    area = found.groupBy("problem_id").agg(F.sum(math.pi * F.col("r") * F.col("r")).alias("area"))
    both = circle_pairs(found).groupBy("problem_id").agg(*[F.sum(c).alias(n) for c, n in (("shared", "overlap"), ("depth", "depth"), ("term", "separation"))])
    out = area.join(both, "problem_id", "left").fillna(0.0, ["overlap", "depth", "separation"])
    cost = F.col("area") + penalty * F.pow("overlap", F.lit(2 if squared else 1)) + weight * F.col("separation")
    return out.withColumn("cost", cost).select("problem_id", *[F.round(c, 6).alias(c) for c in ("area", "overlap", "depth", "separation", "cost")])


def continuity(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean distance, in degrees, of points from the mean of their group."""
    own = Window.partitionBy("problem_id", "label")
    rows = points.select("problem_id", "point_idx", "lat", "lng").join(labels, ["problem_id", "point_idx"])
    rows = rows.withColumns({"c_lat": F.avg("lat").over(own), "c_lng": F.avg("lng").over(own)})
    return rows.groupBy("problem_id").agg(F.round(F.avg(degrees_apart(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"))), 9).alias("continuity"))


def centre_distances(points: DataFrame, labels: DataFrame) -> DataFrame:
    mean = circles(points, labels)
    a, b = (mean.select("problem_id", F.col("label").alias(f"label_{k}"), F.col("lat").alias(f"lat_{k}"), F.col("lng").alias(f"lng_{k}")) for k in "ab")
    return a.join(b, "problem_id").filter("label_a < label_b").select("problem_id", "label_a", "label_b", haversine_km(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b")).alias("km"))


def nearest_groups(points: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """``problem_id, label_a, label_b``: each group with its k nearest, both ways."""
    d = centre_distances(points, labels)
    both = d.union(d.select("problem_id", F.col("label_b").alias("label_a"), F.col("label_a").alias("label_b"), "km"))
    near = both.withColumn("n", F.row_number().over(Window.partitionBy("problem_id", "label_a").orderBy("km", "label_b"))).filter(F.col("n") <= k)
    one = near.select("problem_id", "label_a", "label_b")
    return one.union(near.select("problem_id", F.col("label_b").alias("label_a"), F.col("label_a").alias("label_b"))).distinct()


def extent(points: DataFrame) -> DataFrame:
    """Bounding box, its sides in km, and planar distances to the centre."""
    own = Window.partitionBy("problem_id")
    rows = points.withColumns({"c_lat": F.avg("lat").over(own), "c_lng": F.avg("lng").over(own)})
    d = planar_km(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"))
    return rows.groupBy("problem_id").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("lat", "lng") for f, n in ((F.min, "min"), (F.max, "max"))],
        F.round((F.max("lng") - F.min("lng")) * 85.0, 6).alias("width_km"), F.round((F.max("lat") - F.min("lat")) * 111.0, 6).alias("height_km"),
        F.round(F.avg(d), 6).alias("mean_km"), F.round(F.max(d), 6).alias("max_km"), F.round(F.min(d), 6).alias("min_km"),
    )


def improvement(before: Column, after: Column) -> Column:
    """Reduction in percent, 0 from nothing."""
    return F.when(before != 0, F.round((before - after) / before * 100, 6)).otherwise(0.0)


def differences(table: DataFrame, first: str, second: str) -> DataFrame:
    """``problem_id, metric``, the figures of two strategies of :func:`compared`, and ``difference``: the second less the first."""
    return table.select("problem_id", "metric", first, second, F.round(F.col(second) - F.col(first), 6).alias("difference"))


def compared(metrics: DataFrame, strategies: list[str]) -> DataFrame:
    """One row per problem and metric, a column per strategy."""
    names = ("total_days", "total_points", "total_distance_km", "total_hours", "max_day_points", "avg_day_distance", "overtime_days")
    long = metrics.select("problem_id", "strategy", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m"))
    return long.select("problem_id", "strategy", "m.*").groupBy("problem_id", "metric").pivot("strategy", strategies).agg(F.max("value"))


def zipped_days(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two plans day by day; the old plan's surplus days are left out."""
    o, n = (p.select("problem_id", "day", *[F.col(c).alias(f"{k}_{c}") for c in ("point_count", "drive_distance_km")]) for p, k in ((old, "old"), (new, "new")))
    return o.join(n, ["problem_id", "day"], "right")
