"""Readers: tables of text cells with their row order, mapped to points, surveys, corrections and gazetteers.

Every reader gives STRING cells and ``row_no`` (0-based), as names like 001 must stay text and order has a meaning.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cell, without
from ..registers import READERS
from .sheets import read_sheets


def _numbered(df: DataFrame) -> DataFrame:
    """Adds ``row_no`` to the rows of files, in order of the files' names, and within a file of its blocks and rows.

    A block is read by one task from its first row to its last, so its rows have consecutive ids there.
    """
    named = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    counts = named.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    starts = counts.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")) - F.col("_first")).alias("_from"))
    return named.join(starts, ["_file", "_block"]).withColumn("row_no", F.col("_from") + F.col("_at")).drop("_file", "_block", "_at", "_from")


@READERS.register("csv")
def _csv(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(spark.read.csv(path, header=True, multiLine=True, escape='"'))


@READERS.register("json")
def _json(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(spark.read.json(path, multiLine=True, primitivesAsString=True))


@READERS.register("parquet")
def _parquet(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(spark.read.parquet(path))


READERS.register("xlsx")(read_sheets)
READERS.register("xls")(read_sheets)


def read_table(spark: SparkSession, path: str, kind: str = "") -> DataFrame:
    """A .csv, .json, .parquet, .xlsx or .xls table, or one of a registered reader, with ``row_no``; ``kind`` overrides the ending."""
    return READERS.pick(kind or path.rpartition(".")[2].lower())(spark, path)


def _stops_of(days: DataFrame, *keys: str) -> DataFrame:
    listed = days.select(*keys, F.explode("days").alias("d"))
    return listed.select(*keys, F.col("d.day").cast("int").alias("day"), F.posexplode("d.points").alias("at", "name")).select(*keys, "day", (F.col("at") + 1).alias("stop_seq"), "name")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """The days of an earlier plan's JSON document, one row per stop: ``day, stop_seq, name``."""
    return _stops_of(spark.read.json(path, multiLine=True))


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """The same of exported plans, a line of JSON with ``problem_id, plan`` each: ``problem_id, day, stop_seq, name``."""
    lines = spark.read.schema("problem_id long, plan string").json(path)
    days = lines.select("problem_id", F.from_json("plan", "days array<struct<day: int, points: array<string>>>").alias("p"))
    return _stops_of(days.select("problem_id", "p.days"), "problem_id")


def skip_rows(table: DataFrame, k: int) -> DataFrame:
    """Drops the first ``k`` data rows and numbers the rest from 0."""
    return table.filter(F.col("row_no") >= k).withColumn("row_no", F.col("row_no") - k)


def coordinate(table: DataFrame, mapping: dict[str, Any]) -> tuple[Column, Column]:
    """(lng, lat) by the mapping: a mapped ``coordinates`` column that the table has excludes the separate ones."""
    if (c := mapping.get("coordinates")) and c in table.columns:
        parts = F.split(cell(F.col(c)), ",")
        ok = F.size(parts) >= 2
        return F.when(ok, F.trim(F.get(parts, F.lit(0))).try_cast("double")), F.when(ok, F.trim(F.get(parts, F.lit(1))).try_cast("double"))
    one = lambda k: cell(F.col(mapping[k])).try_cast("double") if mapping.get(k) in table.columns else F.lit(None).cast("double")
    return one("lng"), one("lat")


def points(table: DataFrame, mapping: dict[str, Any], problem: Column | None = None) -> DataFrame:
    """Points of a mapped table: ``problem_id, point_idx, point_id, name, lng, lat, metadata``.

    Rows with a blank name go; ``point_idx`` follows row order per problem; a blank id is the row's number.
    """
    lng, lat = coordinate(table, mapping)
    name = cell(F.col(mapping["name"]))
    own_id = cell(F.col(mapping["id"])) if mapping.get("id") in table.columns else F.lit(None).cast("string")
    extra = [(k, c) for k, c in (mapping.get("metadata") or {}).items() if c in table.columns]
    entries = [x for k, c in extra for x in (F.lit(k), F.coalesce(cell(F.col(c)), F.lit("")))]
    meta = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    rows = table.select((problem if problem is not None else F.lit(0)).cast("long").alias("problem_id"), "row_no", own_id.alias("own"), name.alias("name"), lng.alias("lng"), lat.alias("lat"), meta.alias("metadata"))
    rows = rows.filter("name is not null")
    idx = F.row_number().over(Window.partitionBy("problem_id").orderBy("row_no")) - 1
    return rows.select("problem_id", idx.alias("point_idx"), F.coalesce("own", F.col("row_no").cast("string")).alias("point_id"), "name", "lng", "lat", "metadata")


def placed(rows: DataFrame) -> DataFrame:
    """Rows with a usable coordinate: both parts given and not 0."""
    return rows.filter("lng is not null and lat is not null and lng != 0 and lat != 0")


def first_per_place(rows: DataFrame) -> DataFrame:
    """The first row, by ``point_idx``, of each exact coordinate of a problem."""
    at = Window.partitionBy("problem_id", "lng", "lat").orderBy("point_idx")
    return rows.withColumn("_n", F.row_number().over(at)).filter("_n = 1").drop("_n")


def survey(table: DataFrame, key: str, attributes: dict[str, str]) -> DataFrame:
    """``key, seq, attrs``: the last row of each trimmed key; blank keys go."""
    entries = [x for k, c in attributes.items() for x in (F.lit(k), F.coalesce(cell(F.col(c)), F.lit("")))]
    rows = table.select(cell(F.col(key)).alias("key"), F.col("row_no").alias("seq"), F.create_map(*entries).alias("attrs")).filter("key is not null")
    return rows.groupBy("key").agg(F.min("seq").alias("first_seq"), F.max_by("attrs", "seq").alias("attrs")).withColumnRenamed("first_seq", "seq")


def corrections(table: DataFrame, original: str, corrected: str | None, strip_prefix: str = "") -> DataFrame:
    """``corrected, original``: the last column is the correction unless one is named.

    A correction that does not begin with the first two characters of the prefix is also known with the prefix before it.
    """
    column = corrected if corrected and corrected in table.columns else [c for c in table.columns if c != "row_no"][-1]
    fix = cell(F.col(column))
    also = F.when(F.lit(bool(strip_prefix)) & ~F.startswith(fix, F.lit(strip_prefix[:2])), F.concat(F.lit(strip_prefix), fix))
    rows = table.select("row_no", cell(F.col(original)).alias("original"), F.explode(F.array(fix, also)).alias("corrected"))
    return rows.filter("corrected is not null and original is not null").groupBy("corrected").agg(F.max_by("original", "row_no").alias("original"))


#: Words that mark a row as a contact, not a place.
CONTACT_WORDS = "联系|老师|电话"


def raw_names(table: DataFrame, column: str, district: str) -> DataFrame:
    """``row_no, name``: places of a hand-kept list, cleaned and put in their district."""
    name = cell(F.col(column))
    tidy = F.trim(F.regexp_replace(F.replace(name, F.lit("."), F.lit("·")), " {2,}", " "))
    rows = table.filter(name.isNotNull() & ~name.rlike(CONTACT_WORDS)).select("row_no", tidy.alias("name"))
    return rows.withColumn("name", F.when(F.startswith("name", F.lit(district)), F.col("name")).otherwise(F.concat(F.lit(district), F.col("name"))))


def older_addresses(table: DataFrame, address: str, coordinates: str, prefixes: tuple[str, ...]) -> DataFrame:
    """The older address list: rows with a coordinate, and a short name without the region's prefixes."""
    lng, lat = coordinate(table, {"coordinates": coordinates})
    return table.select("row_no", cell(F.col(address)).alias("name"), without(cell(F.col(address)), *prefixes).alias("short_name"), lng.alias("lng"), lat.alias("lat")).filter("lng is not null and lat is not null")


def by_position(table: DataFrame, names: list[str], skip: int = 2) -> DataFrame:
    """A sheet renamed by position, without its first rows and rows with a blank second cell."""
    kept = skip_rows(table, skip)
    cells = [c for c in kept.columns if c != "row_no"][: len(names)]
    out = kept.select("row_no", *[cell(F.col(f"`{c}`")).alias(n) for c, n in zip(cells, names, strict=False)])
    return out.filter(F.col(names[1]).isNotNull())


def made_points(spark: SparkSession, n: int = 80, outliers: int = 5, seed: int = 42) -> DataFrame:
    """Made-up points: six centres in a band, points around them, and a few far ones; integer arithmetic, same anywhere."""
    draw = lambda k, m: F.pmod((F.col("id") + seed) * (7919 + 104_729 * k) + 4241 * k, F.lit(10_007)) / 10_007.0 * m
    centre = F.pmod(F.col("id"), F.lit(6))
    near_lng = 106.75 + centre * 0.13 + (draw(1, 0.06) - 0.03)
    near_lat = 29.78 + F.pmod(centre * 5, F.lit(6)) * 0.03 + (draw(2, 0.06) - 0.03)
    far = F.col("id") >= n
    return spark.range(n + outliers).select(
        F.lit(0).cast("long").alias("problem_id"), F.col("id").cast("int").alias("point_idx"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("name"),
        F.when(far, 107.08 + draw(3, 1.0) - 0.5).otherwise(near_lng).alias("lng"), F.when(far, 29.85 + draw(4, 1.0) - 0.5).otherwise(near_lat).alias("lat"),
    )


def template(spark: SparkSession) -> DataFrame:
    """The blank table that a user fills in, with sample rows."""
    rows = [(k, f"示例地址{k}号", f"示例小区{k}", "") for k in range(1, 6)]
    return spark.createDataFrame(rows, "`序号` int, `地址` string, `小区名称` string, `备注` string")
