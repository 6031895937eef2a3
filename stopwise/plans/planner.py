"""The planner: points in, a plan's tables out."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PlanConfig, load, overridden
from ..operators import match, metrics, overnight, pairs, shared, tours
from ..operators.distances import Rule
from ..registers import GEOCODERS
from ..sources import tables
from .strategies import STRATEGIES, known_distances


@GEOCODERS.register("gazetteer")
def _gazetteer(spark: SparkSession, config: PlanConfig) -> DataFrame:
    return spark.read.parquet(config.strategy.options["gazetteer"])


@dataclass
class Plan:
    """``days`` and ``stops`` of a strategy, the plan's figures and, looked for when first asked for, the points that it leaves out."""

    strategy: str
    points: DataFrame
    stops: DataFrame
    days: DataFrame
    metrics: DataFrame
    edges: DataFrame | Rule | None = None

    @cached_property
    def unassigned(self) -> DataFrame:
        """``problem_id, point_idx, name, nearest_km``."""
        left = self.points.join(self.stops.select("problem_id", "point_idx"), ["problem_id", "point_idx"], "left_anti")
        near = pairs.nearest(self.points, self.edges, left).select("problem_id", "point_idx", "nearest_km")
        return left.select("problem_id", "point_idx", "name").join(near, ["problem_id", "point_idx"], "left")


class Planner:
    """Runs strategies over the points of many problems at once. The stops are made and written once, when a plan is run."""

    def __init__(self, spark: SparkSession, config: PlanConfig | str, settings: dict[str, str] | None = None):
        self.spark = spark
        self.config = overridden(load(config) if isinstance(config, str) else config, settings or {})

    def points(self) -> DataFrame:
        """The configured points, with what the survey and the corrections tell of them."""
        d = self.config.data
        read = lambda s: tables.skip_rows(tables.read_table(self.spark, s.file, s.format), s.skip_rows)
        found = tables.placed(tables.points(read(d.points), d.points.columns))
        if not d.survey.file:
            return found
        survey = tables.survey(read(d.survey), d.survey.match_key, d.survey.columns)
        if d.corrections.file:
            fixes = tables.corrections(read(d.corrections), d.corrections.original, d.corrections.corrected, d.survey.strip_prefix)
        else:
            fixes = self.spark.createDataFrame([], "corrected string, original string")
        keyed = found.select(F.struct("problem_id", "point_idx").alias("row_id"), "name")
        told = match.cascade(keyed, survey, fixes, d.survey.strip_prefix, d.survey.match_mode)
        told = told.select("row_id.problem_id", "row_id.point_idx", "attrs")
        both = F.map_from_entries(F.concat(F.map_entries(F.map_filter("metadata", lambda k, v: ~F.coalesce(F.map_contains_key("attrs", k), F.lit(False)))), F.coalesce(F.map_entries("attrs"), F.array().cast("array<struct<key:string,value:string>>"))))
        return found.join(told, ["problem_id", "point_idx"], "left").withColumn("metadata", both).drop("attrs")

    def run(self, points: DataFrame | None = None, strategy: str | None = None) -> Plan:
        points = self.points() if points is None else points
        name, c = strategy or self.config.strategy.name, self.config.constraints
        if name not in STRATEGIES:
            raise ValueError(f"no strategy {name}; there are {', '.join(sorted(STRATEGIES))}")
        config = self._with_base(points)
        edges = known_distances(points, config)
        if edges is not None and not isinstance(edges, Rule):  # every step reads a table, and it may be long in the making
            path = f"{shared.folder(self.spark)}/distances-{uuid.uuid4().hex[:12]}"
            edges.select("problem_id", "i", "j", "km").write.parquet(path)
            config = replace(config, distance=replace(config.distance, provider="written", options={**config.distance.options, "written": path}))
            edges = known_distances(points, config)
        stops = shared.cut(STRATEGIES[name](points, config), "stops")  # days, what is left out and figures all read them
        if "trip_type" in stops.columns:
            base = config.base_point
            days = overnight.day_totals(stops, points, c, None if base.lat is None or base.lng is None else (base.lat, base.lng), config.distance.avg_speed_kmh, edges)
        else:
            days = tours.day_rollup(stops, points, c, config.distance.avg_speed_kmh, edges=edges)
        return Plan(name, points, stops, days, tours.plan_metrics(days, c), edges)

    def _with_base(self, points: DataFrame) -> PlanConfig:
        """The configuration with the base's coordinate: as given, else by its name by the geocoder of
        ``strategy.options.geocoder`` (``gazetteer``: the Parquet table ``name, lng, lat`` of that option), else that of the point of this name."""
        base = self.config.base_point
        if not base.name or (base.lat is not None and base.lng is not None):
            return self.config
        geocoder = self.config.strategy.options.get("geocoder", "gazetteer" if self.config.strategy.options.get("gazetteer") else None)
        known = GEOCODERS.pick(geocoder)(self.spark, self.config) if geocoder else points
        given = self.spark.createDataFrame([(0, base.name, base.lng, base.lat)], "problem_id long, name string, lng double, lat double")
        found = overnight.base_coordinate(given, known.filter(F.col("name") == base.name)).first()
        return replace(self.config, base_point=replace(base, lng=found["lng"], lat=found["lat"]))

    def compare(self, strategies: list[str], points: DataFrame | None = None) -> DataFrame:
        """One row per problem and metric, a column per strategy."""
        points = self.points() if points is None else points
        rows = None
        for name in strategies:
            own = self.run(points, name).metrics.withColumn("strategy", F.lit(name))
            rows = own if rows is None else rows.unionByName(own)
        return metrics.compared(rows, strategies)
