"""The pair relation of the points of each problem, nearest neighbours and range joins.

``points`` has ``problem_id, point_idx, name, lng, lat``; extra columns are left alone or dropped, never read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, near_km, pair_km, rounded
from . import shared
from .distances import Rule


def _side(points: DataFrame, tag: str) -> DataFrame:
    return points.select("problem_id", F.col("point_idx").alias(tag), F.col("lat").alias(f"lat_{tag}"), F.col("lng").alias(f"lng_{tag}"))


def _km(a: str = "i", b: str = "j"):
    return haversine_km(F.col(f"lat_{a}"), F.col(f"lng_{a}"), F.col(f"lat_{b}"), F.col(f"lng_{b}"))


def pairs(points: DataFrame) -> DataFrame:
    """``problem_id, i, j, km`` for i < j. Quadratic by definition, made in many tasks and nowhere kept.

    The points of a problem are dealt into blocks, and two blocks meet in a tile. A tile's task holds the points of one block and reads the
    others past them, so its memory is that of some points, and the largest problem is spread over all tasks; a point is sent to a tile for each block.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = math.ceil(math.sqrt(4 * parts))  # twice as many tiles of a problem as tasks

    def dealt(tag: str) -> DataFrame:
        own = _side(points, tag).withColumns({"own": F.pmod(F.xxhash64(tag), F.lit(blocks).cast("long")), f"cos_{tag}": F.cos(F.radians(f"lat_{tag}"))})
        others = F.explode(F.sequence(*((F.col("own"), F.lit(blocks - 1).cast("long")) if tag == "i" else (F.lit(0).cast("long"), F.col("own"))))).alias("other")
        rows = own.select("*", others).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
        # by a number of partitions that is given, AQE does not lay the few rows into one task
        return rows.drop("own", "other").repartition(parts, "problem_id", "low", "high")

    i, j = dealt("i"), dealt("j")
    met = i.join(j.hint("shuffle_hash"), ["problem_id", "low", "high"]).filter("low < high or i < j")
    return pair_km(met, "i", "j").select("problem_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "km")  # km are the same both ways


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("problem_id", "i", "j", "km").union(edges.select("problem_id", F.col("j").alias("i"), F.col("i").alias("j"), "km"))


def among(edges: DataFrame, active: DataFrame) -> DataFrame:
    """The pairs of which both ends are in ``active`` (``problem_id, point_idx``)."""
    i, j = (active.select("problem_id", F.col("point_idx").alias(t)) for t in "ij")
    return edges.join(i, ["problem_id", "i"], "left_semi").join(j, ["problem_id", "j"], "left_semi")


def celled(points: DataFrame, km: float) -> DataFrame:
    """``problem_id, point_idx, lat, lng`` and the grid cell ``cy, cx`` of each point; points within ``km`` are in the same cell or touching ones."""
    lat_step = km / 111.0
    widest = points.groupBy("problem_id").agg(F.max(F.abs("lat")).alias("far"))
    lng_step = F.lit(lat_step) / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.col("far") + lat_step))))
    return points.join(widest, "problem_id").select("problem_id", "point_idx", "lat", "lng", F.floor(F.col("lat") / lat_step).alias("cy"), F.floor(F.col("lng") / lng_step).alias("cx"))


def _meetings(asked: DataFrame, rows: DataFrame, *extra: str) -> DataFrame:
    """``problem_id, i, j`` and the places of each ``asked`` point and the ``rows`` (:func:`celled`) in the cells around it; ``extra`` columns of both sides."""
    around = F.explode(F.array(*[F.struct((F.col("cy") + dy).alias("cy"), (F.col("cx") + dx).alias("cx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    side = lambda t: [F.col("point_idx").alias(t), F.col("lat").alias(f"lat_{t}"), F.col("lng").alias(f"lng_{t}"), *[F.col(c).alias(f"{c}_{t}") for c in extra]]
    # a few points in one task would make all their pairs there
    asked = asked.repartition(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), "problem_id", "point_idx")
    left = asked.select("problem_id", *side("i"), around.alias("c")).select("*", "c.cy", "c.cx").drop("c")
    return left.join(rows.select("problem_id", *side("j"), "cy", "cx"), ["problem_id", "cy", "cx"])


def met(asked: DataFrame, rows: DataFrame, *extra: str) -> DataFrame:
    """:func:`_meetings` with their ``km``."""
    return _meetings(asked, rows, *extra).select("problem_id", "i", "j", _km().alias("km"), *[f"{c}_{t}" for c in extra for t in "ij"])


def within(points: DataFrame, km: float) -> DataFrame:
    """Pairs i < j at most ``km`` apart, by an equality join on grid cells; no pair product of the problem is made."""
    rows = celled(points, km).withColumn("cos", F.cos(F.radians("lat")))
    return near_km(_meetings(rows, rows, "cos").filter("i < j"), "i", "j", km).select("problem_id", "i", "j", "km")


def ruled(edges: DataFrame, rule: Rule) -> DataFrame:
    """The pairs i < j with the km that a provider's rule tells, and ``by_road``, whether it knows them."""
    i, j = (F.col(c).cast("long") for c in "ij")
    edges = edges.withColumn("by_road", rule.knows(i, j))
    return rounded(edges.withColumn("km", F.when(F.col("by_road"), rule.km(i, j, F.col("km"))).otherwise(F.col("km"))), "km", rule.places)


def reach(points: DataFrame, km: float, edges: DataFrame | Rule | None = None) -> DataFrame:
    """Pairs i < j at most ``km`` apart by the sparse ``edges`` (or rule) of a provider, and by great circle where it knows none."""
    if edges is None:
        return within(points, km)
    if isinstance(edges, Rule):  # without a least share, any pair may be in reach
        least = min(1.0, edges.least)
        # distances are rounded, so a pair at the very end of the reach may be told to be a little beyond it
        return ruled(within(points, km / least + 1e-5) if least > 0 else pairs(points), edges).drop("by_road").filter(F.col("km") <= km)
    known = edges.select("problem_id", "i", "j", "km")
    return within(points, km).join(known, ["problem_id", "i", "j"], "left_anti").unionByName(among(known, points).filter(F.col("km") <= km))


def nearest(points: DataFrame, edges: DataFrame | Rule | None = None, of: DataFrame | None = None) -> DataFrame:
    """``problem_id, point_idx, nearest_idx, nearest_km``; null for a point alone; ties go to the lowest index.

    ``of`` names the points asked about, else all. ``edges``, a provider's sparse table or rule, replaces the great-circle distances
    of its pairs. Points meet those in the grid cells around them only:
    cells start at a size that holds few points and double for the points whose nearest is not yet certain, being farther
    than a cell is wide. Every round is a join by cell and is written to the shared folder.
    """
    asked = (points if of is None else of).select("problem_id", "point_idx").distinct()
    table = None if edges is None or isinstance(edges, Rule) else among(edges.select("problem_id", "i", "j", "km"), points)
    best = _nearest_by_rings(points.select("problem_id", "point_idx", "lat", "lng"), asked, table, edges if isinstance(edges, Rule) else None)
    out = asked.join(best, ["problem_id", "point_idx"], "left")
    return out.select("problem_id", "point_idx", F.col("b.j").alias("nearest_idx"), F.col("b.km").alias("nearest_km"))


#: Points that a first cell holds on average, and the km beyond which no two places on earth are apart.
_CELL_POINTS, _FARTHEST_KM = 4, 20_100.0


def _nearest_by_rings(points: DataFrame, asked: DataFrame, edges: DataFrame | None, rule: Rule | None = None) -> DataFrame:
    """``problem_id, point_idx, b (km, j)`` of the asked points that are not alone."""
    known = None
    if edges is not None:  # of what the provider knows, each point's nearest is enough
        ends = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e")
        both = edges.select("problem_id", "km", ends).select("problem_id", "e.i", "e.j", "km")
        least = shared.cut(both.groupBy("problem_id", "i").agg(F.min("km").alias("least")), "known")  # numbers are kept in a hash map, pairs would be sorted
        known = both.join(least, ["problem_id", "i"]).filter("km = least").groupBy("problem_id", "i").agg(F.min("j").alias("j"), F.min("km").alias("km"))
        known = shared.cut(known.join(asked.withColumnRenamed("point_idx", "i"), ["problem_id", "i"], "left_semi"), "known")
    n = F.count(F.lit(1))
    height, width = (F.max("lat") - F.min("lat")) * 111.0, (F.max("lng") - F.min("lng")) * 111.0
    sizes = points.groupBy("problem_id").agg(n.alias("n"), F.max(F.abs("lat")).alias("far"), F.greatest(F.lit(0.01), F.sqrt(F.greatest(height, F.lit(0.01)) * F.greatest(width, F.lit(0.01)) * _CELL_POINTS / n)).alias("cell_km")).filter("n > 1")
    sizes = shared.cut(sizes, "cells")
    left, found = shared.cut(points.join(asked, ["problem_id", "point_idx"], "left_semi"), "asked"), None
    scale = 1.0
    while not left.isEmpty():
        cells = sizes.select("problem_id", "far", (F.col("cell_km") * scale).alias("cell_km"))
        # the other side also stands beyond the antimeridian
        lng = F.col("lng")
        twice = points.withColumn("lng", F.explode(F.when(lng > 90, F.array(lng, lng - 360)).when(lng < -90, F.array(lng, lng + 360)).otherwise(F.array(lng))))
        i, j = (_celled(side, cells) for side in (left, twice))
        steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
        i = i.select("problem_id", F.col("point_idx").alias("i"), F.col("lat").alias("lat_i"), F.col("lng").alias("lng_i"), "cell_km", "cy", "cx", steps.alias("s"))
        i = i.withColumns({"cy": F.col("cy") + F.col("s.dy"), "cx": F.col("cx") + F.col("s.dx")})
        j = j.select("problem_id", F.col("point_idx").alias("j"), F.col("lat").alias("lat_j"), F.col("lng").alias("lng_j"), "cy", "cx")
        met = i.join(j, ["problem_id", "cy", "cx"]).filter("i != j").select("problem_id", "i", "cell_km", "j", _km().alias("km"))
        if rule is not None:
            met = met.withColumn("km", rule.column(F.least("i", "j"), F.greatest("i", "j"), F.col("km")))
        if known is not None:  # what the provider knows stands for itself, however far the points are on the map
            # a great-circle distance counts only where it is no longer than what is known; the table is cut down to these few pairs before the join
            bound = known.select("problem_id", "i", F.col("km").alias("bound"))
            met = shared.cut(met.join(bound, ["problem_id", "i"], "left").filter("bound is null or km <= bound").drop("bound"), "met")
            asked_of = met.select("problem_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
            stands = edges.select("problem_id", "i", "j", F.lit(0.0).alias("km")).join(asked_of, ["problem_id", "i", "j"], "left_semi")
            met = met.join(both_ways(stands), ["problem_id", "i", "j"], "left_anti")
            own = left.select("problem_id", F.col("point_idx").alias("i")).join(cells.select("problem_id", "cell_km"), "problem_id")
            met = met.unionByName(known.join(own, ["problem_id", "i"]))
        best = met.groupBy("problem_id", F.col("i").alias("point_idx"), "cell_km").agg(F.min(F.struct("km", "j")).alias("b"))
        # by a rule, points that were not met may be as near as its least share of a cell, less what is rounded
        sure = F.col("cell_km") if rule is None else F.col("cell_km") * min(1.0, rule.least) - 1e-5
        best = shared.cut(best.filter((F.col("b.km") <= sure) | (F.col("cell_km") > _FARTHEST_KM)).select("problem_id", "point_idx", "b"), "nearest")
        found = best if found is None else found.unionByName(best)
        left = shared.cut(left.join(best, ["problem_id", "point_idx"], "left_anti").join(sizes.select("problem_id"), "problem_id", "left_semi"), "asked")
        scale *= 2.0
    empty = points.limit(0).select("problem_id", "point_idx", F.struct(F.lit(0.0).alias("km"), F.col("point_idx").alias("j")).alias("b"))
    return empty if found is None else found


def _celled(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds the grid cell of each point, ``cy, cx``; a cell is ``cell_km`` wide at the least."""
    step = F.col("cell_km") / 111.0
    east = step / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.col("far") + step))))
    return points.join(cells, "problem_id").withColumns({"cy": F.floor(F.col("lat") / step), "cx": F.floor(F.col("lng") / east)})


def split_outliers(points: DataFrame, threshold_km: float, edges: DataFrame | Rule | None = None) -> DataFrame:
    """Adds ``nearest_km`` and ``is_outlier``: whether the nearest point is over ``threshold_km`` away; 0 is off."""
    near = nearest(points, edges).drop("nearest_idx")
    off = F.lit(False) if threshold_km <= 0 else F.coalesce(F.col("nearest_km") > threshold_km, F.lit(False))
    return points.join(near, ["problem_id", "point_idx"]).withColumn("is_outlier", off)


def centroid_outliers(points: DataFrame, threshold_km: float) -> DataFrame:
    """Adds ``centre_km`` and ``is_outlier``: whether the mean of the problem's points is over ``threshold_km`` away."""
    centre = points.groupBy("problem_id").agg(F.avg("lat").alias("c_lat"), F.avg("lng").alias("c_lng"))
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"))
    return points.join(centre, "problem_id").withColumn("centre_km", km).withColumn("is_outlier", F.col("centre_km") > threshold_km).drop("c_lat", "c_lng")


def nearest_seed(points: DataFrame, seeds: DataFrame) -> DataFrame:
    """``problem_id, point_idx, label``: the ordinal of the nearest of ``seeds`` (``problem_id, seed, lat, lng``)."""
    s = seeds.select("problem_id", "seed", F.col("lat").alias("lat_j"), F.col("lng").alias("lng_j"))
    km = _side(points, "i").join(s, "problem_id").withColumn("km", _km())
    best = km.groupBy("problem_id", F.col("i").alias("point_idx")).agg(F.min(F.struct("km", "seed")).alias("b"))
    return best.select("problem_id", "point_idx", F.col("b.seed").cast("int").alias("label"))


def road_pairs(edges: DataFrame, road: DataFrame | Rule) -> DataFrame:
    """``edges`` with the road distance where ``road`` (``problem_id, i, j, road_km``, or a rule) has one, else the given one."""
    if isinstance(road, Rule):
        return ruled(edges, road).select("problem_id", "i", "j", "km", "by_road")
    return edges.join(road, ["problem_id", "i", "j"], "left").select(
        "problem_id", "i", "j", F.coalesce("road_km", "km").alias("km"), F.col("road_km").isNotNull().alias("by_road")
    )


def legs(stops: DataFrame, points: DataFrame, edges: DataFrame | Rule | None = None) -> DataFrame:
    """Adds ``leg_km``, the way from each stop to the next of its day (0 at the last), to ``problem_id, day, stop_seq, point_idx``.

    ``edges``, a provider's sparse table (i < j) or rule, replaces the great-circle distances of its pairs.
    """
    placed = stops.join(points.select("problem_id", "point_idx", "lat", "lng"), ["problem_id", "point_idx"])
    after = Window.partitionBy("problem_id", "day").orderBy("stop_seq")
    km = haversine_km(F.col("lat"), F.col("lng"), F.lead("lat").over(after), F.lead("lng").over(after))
    if edges is None:
        return placed.withColumn("leg_km", F.coalesce(km, F.lit(0.0)))
    then = F.lead("point_idx").over(after)
    if isinstance(edges, Rule):
        placed = placed.withColumns({"leg_km": km, "then": then})
        told = edges.column(F.least("point_idx", "then"), F.greatest("point_idx", "then"), F.col("leg_km"))
        return placed.withColumn("leg_km", F.when(F.col("then").isNotNull() & (F.col("then") != F.col("point_idx")), told).otherwise(F.coalesce("leg_km", F.lit(0.0)))).drop("then")
    placed = placed.withColumns({"leg_km": km, "i": F.least("point_idx", then), "j": F.when(then.isNotNull(), F.greatest("point_idx", then))})
    # the legs are few: the table is cut down to them before the join
    known = edges.select("problem_id", "i", "j", F.col("km").alias("known_km")).join(shared.cut(placed.filter("j is not null").select("problem_id", "i", "j"), "legs"), ["problem_id", "i", "j"], "left_semi")
    return placed.join(known, ["problem_id", "i", "j"], "left").withColumn("leg_km", F.coalesce("known_km", "leg_km", F.lit(0.0))).drop("i", "j", "known_km")
