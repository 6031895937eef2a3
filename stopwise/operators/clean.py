"""Address validation, corrections and coordinate resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import hashed_coordinate
from ..functions.text import cell, simplified

#: The four categories of a validated address.
UNMATCHED, WRONG_DISTRICT, VAGUE, MATCHED = "匹配失败", "区域不符", "定位模糊", "匹配成功"


def status(given: Column, district: Column, formatted: Column, target: str, also_formatted: bool = True) -> Column:
    """OK, FAIL or WRONG: whether a geocoded address lies in the target district."""
    inside = F.contains(F.coalesce(district, F.lit("")), F.lit(target))
    if also_formatted:
        inside = inside | F.contains(F.coalesce(formatted, F.lit("")), F.lit(target))
    return F.when(given != "OK", "FAIL").when(inside, "OK").otherwise("WRONG")


def category(given: Column, district: Column, formatted: Column, target: str) -> Column:
    """The four-way category; an address that is no more than its district is vague."""
    return (
        F.when(given != "OK", UNMATCHED)
        .when(~F.contains(F.coalesce(district, F.lit("")), F.lit(target)), WRONG_DISTRICT)
        .when(formatted == district, VAGUE)
        .otherwise(MATCHED)
    )


def problem_order(kind: Column) -> Column:
    return F.when(kind == UNMATCHED, 0).when(kind == WRONG_DISTRICT, 1).when(kind == VAGUE, 2).otherwise(3)


def counters(rows: DataFrame, status_col: str = "status") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status_col) == s).alias(n) for s, n in (("OK", "ok"), ("FAIL", "fail"), ("WRONG", "wrong"))])


def attach(rows: DataFrame, results: DataFrame, key: str = "row_id") -> DataFrame:
    """Geocoding results put back to their rows by row id; rows without a result stay."""
    return rows.join(results, key, "left")


def merge_corrections(rows: DataFrame, fixes: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Rows ``row_id, address, lng, lat`` with corrected addresses; only those are looked up again.

    ``fixes`` has ``address, fixed``, ``gazetteer`` ``address, lng, lat``. Adds ``changed`` and ``found``.
    """
    fix = fixes.select("address", cell(F.col("fixed")).alias("fixed")).filter("fixed is not null").groupBy("address").agg(F.max("fixed").alias("fixed"))
    places = gazetteer.groupBy("address").agg(F.min(F.struct("lng", "lat")).alias("at")).withColumnRenamed("address", "fixed")
    changed = F.coalesce(F.col("fixed") != F.col("address"), F.lit(False))
    out = rows.join(fix, "address", "left").join(places, "fixed", "left").withColumn("changed", changed)
    out = out.withColumn("found", F.col("changed") & F.col("at").isNotNull())
    pick = lambda c: F.when(F.col("changed"), F.col(f"at.{c}")).otherwise(F.col(c)).alias(c)
    return out.select("row_id", F.when(F.col("changed"), F.col("fixed")).otherwise(F.col("address")).alias("address"), pick("lng"), pick("lat"), "changed", "found")


def resolve_coordinates(rows: DataFrame, gazetteer: DataFrame, centre_lat: float, centre_lng: float) -> DataFrame:
    """``row_id, address, lng, lat, coord_source``: the given coordinate, the gazetteer's, or a flagged stand-in."""
    places = gazetteer.groupBy("address").agg(F.min(F.struct("lng", "lat")).alias("at"))
    usable = F.col("lng").isNotNull() & F.col("lat").isNotNull() & (F.col("lng") != 0) & (F.col("lat") != 0)
    lat, lng = hashed_coordinate(F.col("address"), centre_lat, centre_lng)
    kind = F.when(usable, "data").when(F.col("at").isNotNull(), "geocoded").otherwise("fallback")
    out = rows.join(places, "address", "left").withColumn("coord_source", kind)
    pick = lambda c, made: F.when(F.col("coord_source") == "data", F.col(c)).when(F.col("coord_source") == "geocoded", F.col(f"at.{c}")).otherwise(made).alias(c)
    return out.select("row_id", "address", pick("lng", lng), pick("lat", lat), "coord_source")


def repair_by_search(rows: DataFrame, places: DataFrame, district: str) -> DataFrame:
    """The best place for each keyword: searched with the district, alone, then simplified; hits in the district first.

    ``rows`` has ``row_id, keyword``; ``places`` ``keyword, rank, name, place_district``.
    """
    ways = [F.concat(F.lit(district), F.col("keyword")), F.col("keyword"), simplified(F.col("keyword"))]
    asked = rows.select("row_id", F.posexplode(F.array(*ways)).alias("way", "asked"))
    inside = F.coalesce(F.contains("place_district", F.lit(district)), F.lit(False))
    hits = asked.join(places.withColumnRenamed("keyword", "asked"), "asked").withColumn("inside", inside)
    # a later way is tried only if no earlier one gave a hit; within a way a hit in the district wins
    best = hits.groupBy("row_id").agg(F.min(F.struct("way", (~F.col("inside")).alias("outside"), "rank", "name", "place_district")).alias("b"))
    out = rows.join(best, "row_id", "left")
    kind = F.when(F.col("b").isNull(), "FAIL").when(F.col("b.outside"), "OK_OTHER").otherwise("OK")
    return out.select("row_id", "keyword", kind.alias("status"), F.col("b.name").alias("name"), F.col("b.place_district").alias("place_district"))


def final_list(rows: DataFrame) -> DataFrame:
    """``row_id, address``: the corrected address where one was given."""
    return rows.select("row_id", F.coalesce(cell(F.col("fixed")), F.col("address")).alias("address"))


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    at = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(at)).filter("_n = 1").drop("_n")
