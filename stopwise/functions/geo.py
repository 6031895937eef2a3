"""Column builders for distances, times and plane geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Earth radius in km, and the plane's km per degree of latitude and longitude.
EARTH_KM, LAT_KM, LNG_KM = 6371.0, 111.0, 85.0
#: Distances are compared and ordered at this many decimals, so that engines agree on ties.
PLACES = 6


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km, rounded to ``PLACES``; null if a part is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.round(F.lit(2 * EARTH_KM) * F.asin(F.when(a > 1.0, F.lit(1.0)).otherwise(F.sqrt(a))), PLACES)


def pair_km(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``km``, :func:`haversine_km` to the bit, of ``lat_a, lng_a, cos_a`` and the same of b, for many pairs: the cosines of
    latitudes are given, and what is named twice is a column of its own, so that it is worked out once."""
    half = lambda c: F.sin(F.radians(F.col(f"{c}_{b}") - F.col(f"{c}_{a}")) / 2)
    df = df.withColumns({"_y": half("lat"), "_x": half("lng")})
    df = df.withColumn("_a", F.col("_y") * F.col("_y") + F.col(f"cos_{a}") * F.col(f"cos_{b}") * (F.col("_x") * F.col("_x")))
    km = F.lit(2 * EARTH_KM) * F.asin(F.when(F.col("_a") > 1.0, F.lit(1.0)).otherwise(F.sqrt("_a")))
    return rounded(df.withColumn("km", km).drop("_y", "_x", "_a"), "km")


def near_km(df: DataFrame, a: str, b: str, most: float) -> DataFrame:
    """The pairs at most ``most`` km apart with their ``km``; the same columns as for :func:`pair_km`.

    Those that are clearly farther are passed by without an arc or rounding. The arc is told by a generator of one row: a filter on an
    expression is moved below it, where it would be worked out once for each time that it is named.
    """
    half = lambda c: F.pow(F.sin(F.radians(F.col(f"{c}_{b}") - F.col(f"{c}_{a}")) / 2), 2)
    df = df.withColumn("_a", half("lat") + F.col(f"cos_{a}") * F.col(f"cos_{b}") * half("lng"))
    angle = (most + 1e-3) / (2 * EARTH_KM)
    if angle < math.pi / 2 - 1e-3:  # else the sine falls again; nothing is far then
        df = df.filter(F.col("_a") <= math.sin(angle) ** 2)
    arc = F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(F.col("_a") > 1.0, F.lit(1.0)).otherwise(F.col("_a"))))
    return rounded(df.select("*", F.explode(F.array(arc)).alias("km")).drop("_a"), "km").filter(F.col("km") <= most)


def rounded(df: DataFrame, column: str, places: int = PLACES) -> DataFrame:
    """``F.round`` of a column of numbers of 0 or more, the same to the bit.

    That goes by way of decimal text, which is asked for only where the digits after ``places`` are near a half, or the number is so large that
    the product is not sure. It takes a table, as an expression that is named several times would be worked out as often.
    """
    x = F.col(column)
    scaled = x * 10.0**places
    sure = (F.abs(scaled - F.rint(scaled)) < 0.499) & (scaled < 1e12)
    return df.withColumn(column, F.when(sure, F.rint(scaled) / 10.0**places).otherwise(F.round(x, places)))


def planar_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.sqrt(F.pow((lat2 - lat1) * LAT_KM, 2) + F.pow((lng2 - lng1) * LNG_KM, 2))


def degrees_apart(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(lng2 - lng1, 2))


def drive_seconds(km: Column, speed_kmh: float) -> Column:
    """Driving time; 0 without a speed."""
    return km / speed_kmh * 3600 if speed_kmh > 0 else F.lit(0.0)


def drive_minutes(km: Column, speed_kmh: float = 35.0) -> Column:
    return km / speed_kmh * 60


def polyline(encoded: Column) -> Column:
    """``lng,lat;lng,lat`` as an array of (lat, lng)."""
    part = F.filter(F.split(encoded, ";"), lambda p: F.contains(p, F.lit(",")))
    return F.transform(part, lambda p: F.struct(F.element_at(F.split(p, ","), 2).cast("double").alias("lat"), F.element_at(F.split(p, ","), 1).cast("double").alias("lng")))


def straight_line(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """The two-point stand-in for a route that no provider gave."""
    return F.array(F.struct(lat1.alias("lat"), lng1.alias("lng")), F.struct(lat2.alias("lat"), lng2.alias("lng")))


def hashed_coordinate(address: Column, centre_lat: float, centre_lng: float) -> tuple[Column, Column]:
    """A stable stand-in (lat, lng) within 0.25 degrees of a centre, from the address's MD5."""
    part = lambda k: (F.conv(F.substring(F.md5(address.cast("binary")), k, 4), 16, 10).cast("double") / 65535.0 - 0.5) * 0.5
    return F.lit(centre_lat) + part(1), F.lit(centre_lng) + part(5)


def zoom_level(lat_span: Column, lng_span: Column, width_px: int = 800, height_px: int = 600, pad: float = 1.4) -> Column:
    """The largest zoom of 18 to 6 at which the padded extent fits the viewport, else 6."""
    lat, lng = F.greatest(lat_span * pad, F.lit(0.005)), F.greatest(lng_span * pad, F.lit(0.005))
    fits = lambda z: (lng * F.pow(F.lit(2.0), z) * 256 / 360 <= width_px) & (lat * F.pow(F.lit(2.0), z) * 256 / 360 <= height_px)
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(6), F.lit(18)), fits)), F.lit(6))


def circle_polygon(lat: Column, lng: Column, radius: Column, corners: int = 36) -> Column:
    """Corners of a circle of ``radius`` degrees, anticlockwise from east."""
    angle = lambda k: F.radians(k.cast("double") * (360.0 / corners))
    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda k: F.struct((lat + radius * F.sin(angle(k))).alias("lat"), (lng + radius * F.cos(angle(k))).alias("lng")))


def lens_area(d: Column, r1: Column, r2: Column) -> Column:
    """Area that two circles share."""
    unit = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    a = F.pow(r1, 2) * F.acos(unit((d * d + r1 * r1 - r2 * r2) / (2 * d * r1)))
    b = F.pow(r2, 2) * F.acos(unit((d * d + r2 * r2 - r1 * r1) / (2 * d * r2)))
    c = F.sqrt(F.greatest(F.lit(0.0), (-d + r1 + r2) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2))) / 2
    return F.when(d >= r1 + r2, 0.0).when(d <= F.abs(r1 - r2), F.lit(3.141592653589793) * F.pow(F.least(r1, r2), 2)).otherwise(a + b - c)


def circumcircle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """(x, y, r) of the circle through three points; for points nearly on a line, of their longest pair."""
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    sa, sb, sc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    x, y = (sa * (by - cy) + sb * (cy - ay) + sc * (ay - by)) / d, (sa * (cx - bx) + sb * (ax - cx) + sc * (bx - ax)) / d
    dist = lambda px, py, qx, qy: F.sqrt(F.pow(px - qx, 2) + F.pow(py - qy, 2))
    over = lambda px, py, qx, qy: F.struct(dist(px, py, qx, qy).alias("k"), ((px + qx) / 2).alias("x"), ((py + qy) / 2).alias("y"))
    longest = F.array_max(F.array(over(ax, ay, bx, by), over(ax, ay, cx, cy), over(bx, by, cx, cy)))
    flat = F.struct(longest["x"].alias("x"), longest["y"].alias("y"), (longest["k"] / 2).alias("r"))
    return F.when(F.abs(d) < 1e-10, flat).otherwise(F.struct(x.alias("x"), y.alias("y"), dist(x, y, ax, ay).alias("r")))


def in_circle(lat: Column, lng: Column, c_lat: Column, c_lng: Column, r: Column) -> Column:
    return degrees_apart(lat, lng, c_lat, c_lng) <= r + 1e-10
