"""Lookup of points in a survey: exact, through corrections, then loosely.

``points`` has ``row_id, name`` and may have more; ``survey`` has ``key, seq, attrs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import loose, loose_older, without


def _short(points: DataFrame, prefix: str) -> DataFrame:
    return points.select("row_id", "name", F.trim(without(F.col("name"), prefix)).alias("short"))


def exact(points: DataFrame, survey: DataFrame, prefix: str = "") -> DataFrame:
    """``row_id, attrs`` of the points whose short name is a key."""
    return _short(points, prefix).join(survey.select(F.col("key").alias("short"), "attrs"), "short").select("row_id", "attrs")


def by_correction(points: DataFrame, survey: DataFrame, corrections: DataFrame, prefix: str = "") -> DataFrame:
    """Through the correction of the full name, else of the short name."""
    full, part = (corrections.select(F.col("corrected").alias(k), F.col("original").alias(o)) for k, o in (("name", "o_full"), ("short", "o_short")))
    known = _short(points, prefix).join(full, "name", "left").join(part, "short", "left")
    keyed = known.select("row_id", F.coalesce("o_full", "o_short").alias("key")).filter("key is not null")
    keyed = keyed.withColumn("key", F.trim(without(F.col("key"), prefix)))
    return keyed.join(survey.select("key", "attrs"), "key").select("row_id", "attrs")


def containing(inner: DataFrame, outer: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``x, y``: the distinct texts ``x`` of ``inner`` that stand in distinct texts ``y`` of ``outer``; nulls and '' in neither.

    ``y`` is cut into all its parts that are as long as some ``x``, and an equality join finds those that are one, so nothing meets
    but what is returned: at most half the square of its length for each ``y``, however many begin alike. With ``keys``, only
    texts with equal keys meet. The parts are many more than Spark reckons from their table, so they are never broadcast.
    """
    y, x = outer.filter("y != ''").select(*keys, "y").distinct(), inner.filter("x != ''").select(*keys, "x").distinct()
    sizes = F.broadcast(x.select(*keys, F.length("x").alias("k")).distinct())  # no more than the longest text has characters
    sized = y.select(*keys, "y", F.explode(F.sequence(F.lit(1), F.length("y"))).alias("k")).join(sizes, [*keys, "k"])
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("y") - F.col("k") + 1), lambda i: F.substring("y", i, F.col("k"))))
    return sized.select(*keys, "y", F.explode(parts).alias("x")).join(x.hint("merge"), [*keys, "x"]).select(*keys, "x", "y")


def fuzzy(points: DataFrame, survey: DataFrame, prefix: str = "", older: bool = False) -> DataFrame:
    """The first survey row, in its own order, whose key and the short name contain one another, as written or loosely.

    Containment is looked up by equal parts of texts, both ways and for both spellings at once; no point is compared with all keys.
    """
    plain = loose_older if older else loose
    both = lambda c: F.explode(F.array(F.struct(F.lit(False).alias("loosely"), F.col(c).alias("text")), F.struct(F.lit(True).alias("loosely"), plain(F.col(c)).alias("text")))).alias("s")
    left = _short(points, prefix).filter("short != ''").select("row_id", both("short")).select("row_id", "s.*")
    right = survey.filter("key != ''").select("key", "seq", "attrs", both("key")).select("key", "seq", "attrs", "s.*")
    names, keys = left.select("loosely", "text").distinct(), right.select("loosely", "text").distinct()
    side = lambda df, c, within: df.select("loosely", F.lit(within).alias("name_within"), F.col("text").alias(c))
    met = containing(side(names, "x", True).union(side(keys, "x", False)), side(keys, "y", True).union(side(names, "y", False)), keys=("loosely", "name_within"))
    pairs = met.select("loosely", F.when(F.col("name_within"), F.col("x")).otherwise(F.col("y")).alias("text"), F.when(F.col("name_within"), F.col("y")).otherwise(F.col("x")).alias("held")).distinct()
    fits = pairs.join(left, ["loosely", "text"]).join(right.withColumnRenamed("text", "held"), ["loosely", "held"])
    return fits.groupBy("row_id").agg(F.min_by("attrs", F.struct("seq", "key")).alias("attrs"))


def cascade(points: DataFrame, survey: DataFrame, corrections: DataFrame, prefix: str = "", mode: str = "fuzzy", older: bool = False) -> DataFrame:
    """``row_id, name, attrs, matched_by``: exact, then by correction, then (``mode`` fuzzy) loosely; null without a match."""
    found = exact(points, survey, prefix).withColumn("matched_by", F.lit("exact"))
    rest = points.join(found, "row_id", "left_anti")
    found = found.unionByName(by_correction(rest, survey, corrections, prefix).withColumn("matched_by", F.lit("correction")))
    if mode == "fuzzy":
        rest = points.join(found, "row_id", "left_anti")
        found = found.unionByName(fuzzy(rest, survey, prefix, older).withColumn("matched_by", F.lit("fuzzy")))
    return points.select("row_id", "name").join(found, "row_id", "left")
