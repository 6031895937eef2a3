"""Planning inputs derived from the supplied tables, by integer arithmetic that is equal in any SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Base, Constraints, PlanConfig
from ..functions.geo import haversine_km
from ..operators.distances import Rule

#: The depot.
BASE_LNG, BASE_LAT = 107.08, 29.85
LIMITS = Constraints(max_daily_hours=4.0, max_daily_points=5, stop_time_per_point_min=15.0, roundtrip_overhead_min=155.0, overnight_threshold_km=25.0)
CONFIG = PlanConfig(base_point=Base("depot", BASE_LNG, BASE_LAT), constraints=LIMITS)

_POINTS = "cast({problem} as bigint) as problem_id, cast({key} as int) as point_idx, {name} as name, 106.68{d} + (({key}*7919)%10007)/10007.0{d}*0.8{d} as lng, 29.75{d} + (({key}*4241+17)%10007)/10007.0{d}*0.2{d} as lat"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers as one problem."""
    return _table(spark, sf_dir, "supplier").selectExpr(*_split(_POINTS.format(problem="0", key="s_suppkey", name="s_name", d="D")))


def many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, a problem per nation."""
    return _table(spark, sf_dir, "supplier").selectExpr(*_split(_POINTS.format(problem="s_nationkey", key="s_suppkey", name="s_name", d="D")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, a problem per nation."""
    return _table(spark, sf_dir, "customer").selectExpr(*_split(_POINTS.format(problem="c_nationkey", key="c_custkey", name="c_name", d="D")))


def _split(text: str) -> list[str]:
    return [x.strip() for x in text.split(", ")]


SQL_ONE = "pts as (select " + _POINTS.format(problem="0", key="s_suppkey", name="s_name", d="e0") + " from supplier)"
SQL_MANY = SQL_ONE.replace("cast(0 as bigint)", "cast(s_nationkey as bigint)")
SQL_CUSTOMERS = "pts as (select " + _POINTS.format(problem="c_nationkey", key="c_custkey", name="c_name", d="e0") + " from customer)"
#: Great-circle km between aliases a and b.
SQL_KM = "round(12742.0e0*asin(least(1.0e0, sqrt(pow(sin(radians({b}.lat-{a}.lat)/2),2)+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lng-{a}.lng)/2),2)))),6)"
SQL_PAIRS = "pairs as (select a.problem_id, a.point_idx as i, b.point_idx as j, " + SQL_KM.format(a="a", b="b") + " as km from pts a join pts b on a.problem_id=b.problem_id and a.point_idx<b.point_idx)"
SQL_BOTH = "both_ways as (select problem_id,i,j,km from pairs union all select problem_id,j,i,km from pairs)"


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier rows with blank and nan names and broken coordinates (``lng,lat`` in millionths)."""
    return _table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as row_no",
        "case when s_suppkey%17=0 then '' when s_suppkey%19=0 then 'nan' else concat('  Zone.', s_name, ' ') end as name_raw",
        "case when s_suppkey%11=0 then null when s_suppkey%13=0 then 'bad' else concat(cast(106680000+((s_suppkey*7919)%10007)*80 as string),',',cast(29750000+((s_suppkey*4241+17)%10007)*20 as string)) end as coord_micro",
        "s_nationkey as nation",
    )


SQL_RAW = """raw as (select s_suppkey as row_no,
 case when s_suppkey%17=0 then '' when s_suppkey%19=0 then 'nan' else concat('  Zone.', s_name, ' ') end as name_raw,
 case when s_suppkey%11=0 then null when s_suppkey%13=0 then 'bad'
  else concat(cast(106680000+((s_suppkey*7919)%10007)*80 as varchar),',',cast(29750000+((s_suppkey*4241+17)%10007)*20 as varchar)) end as coord_micro from supplier)"""


def survey_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").filter("s_suppkey%5<>0").selectExpr(
        "s_suppkey as seq",
        "case when s_suppkey%4=0 then s_name when s_suppkey%4=1 then concat('(',replace(s_name,'#','-'),')') else concat('old-',cast(s_suppkey as string)) end as key",
        "map('org', concat('org-',cast(s_nationkey as string))) as attrs",
    )


SQL_SURVEY = """survey as (select s_suppkey as seq,
 case when s_suppkey%4=0 then s_name when s_suppkey%4=1 then concat('(',replace(s_name,'#','-'),')') else concat('old-',cast(s_suppkey as varchar)) end as key,
 concat('org-',cast(s_nationkey as varchar)) as org from supplier where s_suppkey%5<>0)"""


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").filter("s_suppkey%4=2").selectExpr("concat('Zone.',s_name) as corrected", "concat('old-',cast(s_suppkey as string)) as original")


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.concat(F.lit("Zone."), "s_name").alias("name"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geocoding results for customers: failures, vague hits and hits."""
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).selectExpr(
        "c_custkey as row_id", "case when c_custkey%13=0 then 'FAIL' else 'OK' end as given", "case when c_custkey%13=0 then '' else n_name end as district",
        "case when c_custkey%13=0 then '' when c_custkey%7=0 then n_name else concat(n_name,' ',c_name) end as formatted",
    )


SQL_VALIDATED = """found as (select c_custkey as row_id, case when c_custkey%13=0 then 'FAIL' else 'OK' end as given,
 case when c_custkey%13=0 then '' else n_name end as district,
 case when c_custkey%13=0 then '' when c_custkey%7=0 then n_name else concat(n_name,' ',c_name) end as formatted
 from customer join nation on c_nationkey=n_nationkey)"""


def road(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detour factors for most pairs of suppliers of a nation."""
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    a, b = s.withColumnRenamed("s_suppkey", "i"), s.withColumnRenamed("s_suppkey", "j")
    a = a.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "i")  # a small file is one task, its pairs are not
    both = a.join(b, "s_nationkey").filter("i < j and (i*31+j)%9<>0")
    return both.selectExpr("cast(s_nationkey as bigint) as problem_id", "cast(i as int) as i", "cast(j as int) as j", "1.0D+((i+j)%7)/10.0D as detour")


#: What the road table holds, told pair by pair: its km are the detour factor times the great-circle ones.
ROAD_RULE = Rule(lambda i, j: (i * 31 + j) % 9 != 0, lambda i, j, km: km * (1.0 + (i + j) % 7 / 10.0), least=1.0)


def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The road table: ``problem_id, i, j, road_km`` of the pairs that have a detour."""
    points = many(spark, sf_dir)
    at = lambda tag: points.select("problem_id", F.col("point_idx").alias(tag), F.col("lat").alias(f"lat_{tag}"), F.col("lng").alias(f"lng_{tag}"))
    placed = road(spark, sf_dir).join(at("i"), ["problem_id", "i"]).join(at("j"), ["problem_id", "j"])
    km = haversine_km(F.col("lat_i"), F.col("lng_i"), F.col("lat_j"), F.col("lng_j")) * F.col("detour")
    return placed.select("problem_id", "i", "j", F.round(km, 8).alias("road_km"))


SQL_ROAD = "road as (select cast(a.s_nationkey as bigint) as problem_id, a.s_suppkey as i, b.s_suppkey as j, 1.0e0+((a.s_suppkey+b.s_suppkey)%7)/10.0e0 as detour from supplier a join supplier b on a.s_nationkey=b.s_nationkey and a.s_suppkey<b.s_suppkey where (a.s_suppkey*31+b.s_suppkey)%9<>0)"
