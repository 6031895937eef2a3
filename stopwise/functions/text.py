"""Column builders for names, addresses and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that loose matching ignores, and the word that the older matching drops.
IGNORED, DROPPED = ".-·小区（）()", "小区"


def cell(c: Column) -> Column:
    """A trimmed cell; blank and the text ``nan`` are null."""
    t = F.trim(c.cast("string"))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def without(c: Column, *parts: str) -> Column:
    """The text with each part removed wherever it stands."""
    for p in parts:
        c = F.replace(c, F.lit(p), F.lit("")) if p else c
    return c


def loose(c: Column) -> Column:
    return F.translate(c, IGNORED, "")


def loose_older(c: Column) -> Column:
    return F.translate(without(c, DROPPED), "（）", "()")


def simplified(c: Column) -> Column:
    """A search keyword cut to what follows 号, and without 小区."""
    after = F.element_at(F.split(c, "号"), -1)
    return without(F.when(after != "", after).otherwise(c), DROPPED)


def label_tail(c: Column, n: int = 20) -> Column:
    return F.when(F.length(c) > n, F.right(c, F.lit(n))).otherwise(c)


def day_number(c: Column) -> Column:
    """The number in a label 第N天, null without one."""
    n = F.regexp_extract(c, r"第(\d+)天", 1)
    return F.when(n != "", n.cast("int"))


def day_label(n: Column) -> Column:
    return F.concat(F.lit("第"), n.cast("string"), F.lit("天"))


def lng_lat(lng: Column, lat: Column) -> Column:
    return F.format_string("%.6f,%.6f", lng, lat)


def marker(position: Column, total: Column) -> Column:
    """Marker colour of a stop by its place in the day."""
    return F.when(position == 1, "green").when(position == total, "red").otherwise("blue")


def field(name: str) -> Column:
    """The column that an export names ``day``, ``index``, ``name``, ``id``, ``lng``, ``lat``, ``coordinates`` or ``metadata.key``; else ''."""
    plain = {"day": "day", "index": "stop_seq", "name": "name", "id": "point_id", "lng": "lng", "lat": "lat", "trip_type": "trip_type", "start": "start_name", "end": "end_name"}
    if name == "coordinates":
        return lng_lat(F.col("lng"), F.col("lat"))
    if name.startswith("metadata."):
        return F.coalesce(F.try_element_at("metadata", F.lit(name.removeprefix("metadata."))), F.lit(""))
    return F.col(plain[name]).cast("string") if name in plain else F.lit("")
