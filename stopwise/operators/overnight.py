"""Trips with a night away: which points need one, where to stay, and the two days of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Constraints
from ..functions.geo import PLACES, drive_seconds, haversine_km
from .distances import Rule
from .pairs import legs
from .tours import day_rollup


def classify(points: DataFrame, base_lat: float | None, base_lng: float | None, threshold_km: float) -> DataFrame:
    """Adds ``base_km`` and ``trip_type``: overnight beyond the threshold, if there is a base and a threshold."""
    if base_lat is None or base_lng is None:
        return points.withColumn("base_km", F.lit(None).cast("double")).withColumn("trip_type", F.lit("single_day"))
    km = haversine_km(F.col("lat"), F.col("lng"), F.lit(base_lat), F.lit(base_lng))
    far = (km > threshold_km) if threshold_km > 0 else F.lit(False)
    return points.withColumn("base_km", km).withColumn("trip_type", F.when(far, "overnight").otherwise("single_day"))


def hotels(points: DataFrame, labels: DataFrame, radius_km: float = 3.0) -> DataFrame:
    """``problem_id, label, lat, lng, near_idx, near_km, within_radius``: a stay at each group's mean, named after its nearest."""
    rows = points.select("problem_id", "point_idx", "lat", "lng").join(labels, ["problem_id", "point_idx"])
    centre = rows.groupBy("problem_id", "label").agg(F.round(F.avg("lat"), 9).alias("h_lat"), F.round(F.avg("lng"), 9).alias("h_lng"))
    near = rows.join(centre, ["problem_id", "label"]).withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.col("h_lat"), F.col("h_lng")))
    best = near.groupBy("problem_id", "label").agg(F.first("h_lat").alias("lat"), F.first("h_lng").alias("lng"), F.min(F.struct("km", "point_idx")).alias("m"))
    return best.select("problem_id", "label", "lat", "lng", F.col("m.point_idx").alias("near_idx"), F.col("m.km").alias("near_km"), (F.col("m.km") <= radius_km).alias("within_radius"))


def halves(tours: DataFrame) -> DataFrame:
    """Each group's tour in two days: the first half, rounded down, and the rest; a single point has one day."""
    n = tours.groupBy("problem_id", "label").agg(F.count(F.lit(1)).alias("n"))
    half = F.floor(F.col("n") / 2)
    first = (F.col("n") <= 1) | (F.col("stop_seq") <= half)
    rows = tours.join(n, ["problem_id", "label"]).withColumn("part", F.when(first, 1).otherwise(2))
    return rows.select("problem_id", "label", "part", F.when(first, F.col("stop_seq")).otherwise(F.col("stop_seq") - half).cast("int").alias("stop_seq"), "point_idx")


def two_day_totals(parts: DataFrame, points: DataFrame, stays: DataFrame, base_lat: float, base_lng: float, stop_min: float, speed_kmh: float = 35.0, edges: DataFrame | Rule | None = None) -> DataFrame:
    """Day 1 runs from base over its stops to the hotel, day 2 from the hotel over its stops to base; no other overhead.

    ``edges``, a provider's sparse table or rule, replaces great-circle distances between stops; base and hotel are no points of it.
    """
    own = legs(parts.withColumn("day", F.struct("label", "part")), points, edges)
    here = F.struct("lat", "lng")
    day = own.groupBy("problem_id", "label", "part").agg(F.sum("leg_km").alias("inner"), F.min_by(here, "stop_seq").alias("first"), F.max_by(here, "stop_seq").alias("last"), F.count(F.lit(1)).alias("point_count"))
    leg = lambda a, b: haversine_km(a["lat"], a["lng"], b["lat"], b["lng"])
    day = day.join(stays.select("problem_id", "label", here.alias("h")), ["problem_id", "label"])
    base = F.struct(F.lit(base_lat).alias("lat"), F.lit(base_lng).alias("lng"))
    first, last, one = F.col("first"), F.col("last"), F.col("part") == 1
    ends = F.when(one, leg(base, first) + leg(last, F.col("h"))).otherwise(leg(F.col("h"), first) + leg(last, base))
    out = day.select("problem_id", "label", "part", "point_count", F.round(F.col("inner") + ends, PLACES).alias("km"))
    minutes, stay = drive_seconds(F.col("km"), speed_kmh) / 60, F.col("point_count") * stop_min
    return out.select(
        "problem_id", "label", "part", "point_count", F.round("km", 1).alias("drive_distance_km"), F.round(minutes, 1).alias("drive_time_min"),
        F.round(stay, 1).alias("stop_time_min"), F.round((minutes + stay) / 60, 1).alias("total_time_hours"),
    )


def day_totals(stops: DataFrame, points: DataFrame, limits: Constraints, base: tuple[float, float] | None, speed_kmh: float = 35.0, edges: DataFrame | Rule | None = None) -> DataFrame:
    """The days of :func:`renumbered` stops with their ``trip_type`` and, of trips with a night away, the stay (``hotel_lat``,
    ``hotel_lng``, ``hotel_near_idx``). Single days bear the round trip's overhead, the others their ways to base and stay."""
    single = day_rollup(stops.filter("trip_type = 'single_day'"), points, limits, speed_kmh, edges=edges).withColumn("trip_type", F.lit("single_day"))
    if base is None:
        return single.withColumns({"hotel_lat": F.lit(None).cast("double"), "hotel_lng": F.lit(None).cast("double"), "hotel_near_idx": F.lit(None).cast("int")})
    parts = stops.filter("trip_type = 'overnight'")
    stays = hotels(points, parts.select("problem_id", "point_idx", "label"), limits.overnight_hotel_radius_km)
    numbers = parts.select("problem_id", "label", "part", "day").distinct()
    nights = two_day_totals(parts.select("problem_id", "label", "part", "stop_seq", "point_idx"), points, stays, *base, limits.stop_time_per_point_min, speed_kmh, edges).join(numbers, ["problem_id", "label", "part"])
    nights = nights.join(stays.select("problem_id", "label", F.col("lat").alias("hotel_lat"), F.col("lng").alias("hotel_lng"), F.col("near_idx").alias("hotel_near_idx")), ["problem_id", "label"])
    return single.unionByName(nights.drop("label", "part").withColumn("trip_type", F.lit("overnight")), allowMissingColumns=True)


def renumbered(single: DataFrame, parts: DataFrame) -> DataFrame:
    """One run of day numbers per problem: the single-day plan's days first, then each group's days, with ``label, part``."""
    last = single.groupBy("problem_id").agg(F.max("day").alias("last"))
    order = Window.partitionBy("problem_id").orderBy("label", "part")
    later = parts.join(last, "problem_id", "left").withColumn("day", (F.coalesce("last", F.lit(0)) + F.dense_rank().over(order)).cast("int"))
    later = later.select("problem_id", "day", "stop_seq", "point_idx", F.lit("overnight").alias("trip_type"), "label", "part")
    return single.select("problem_id", "day", "stop_seq", "point_idx", F.lit("single_day").alias("trip_type")).unionByName(later, allowMissingColumns=True)


def trip_counts(points: DataFrame, stops: DataFrame) -> DataFrame:
    """Points of each trip type and days with a night away."""
    kinds = points.groupBy("problem_id").agg(F.count_if(F.col("trip_type") == "single_day").alias("single_day_points"), F.count_if(F.col("trip_type") == "overnight").alias("overnight_points"))
    nights = stops.filter("trip_type = 'overnight'").groupBy("problem_id").agg(F.count_distinct("day").alias("overnight_days"))
    return kinds.join(nights, "problem_id", "left").withColumn("overnight_days", F.coalesce("overnight_days", F.lit(0).cast("long")))


def base_coordinate(given: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``problem_id, lng, lat``: as given, else by the base's name, else null."""
    known = gazetteer.groupBy("name").agg(F.min(F.struct("lng", "lat")).alias("at"))
    own = F.col("lng").isNotNull() & F.col("lat").isNotNull()
    pick = lambda c: F.when(own, F.col(c)).otherwise(F.col(f"at.{c}")).alias(c)
    return given.join(known, "name", "left").select("problem_id", pick("lng"), pick("lat"))
