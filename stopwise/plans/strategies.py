"""Named strategies: each turns points into stops of days. Others can be added by :func:`register`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PlanConfig, single_day
from ..operators import density, growth, overnight, pairs, slices, tours
from ..operators.distances import Rule
from ..registers import DISTANCES

#: A strategy gives ``problem_id, day, stop_seq, point_idx`` for the points and options that it gets.
Strategy = Callable[[DataFrame, PlanConfig], DataFrame]
STRATEGIES: dict[str, Strategy] = {}


def register(name: str) -> Callable[[Strategy], Strategy]:
    def add(f: Strategy) -> Strategy:
        STRATEGIES[name] = f
        return f

    return add


def _days_of(points: DataFrame, labels: DataFrame, whole: bool, edges: DataFrame | Rule | None) -> DataFrame:
    """Each group is a day, numbered by its label; label -1 is left out."""
    own = tours.group_tours(points, labels.filter("label >= 0"), whole, edges=edges)
    return own.select("problem_id", (F.col("label") + 1).alias("day"), "stop_seq", "point_idx")


def _base(config: PlanConfig) -> tuple[float, float] | None:
    b = config.base_point
    return (b.lat, b.lng) if b.lat is not None and b.lng is not None else None


def known_distances(points: DataFrame, config: PlanConfig) -> DataFrame | Rule | None:
    """What the configured provider knows: a sparse table or a rule for every strategy, or None for great-circle distances."""
    return DISTANCES.pick(config.distance.provider)(points, config)


@register("tsp")
def tsp(points: DataFrame, config: PlanConfig) -> DataFrame:
    """A nearest-neighbour tour, 2-opt, days. ``tsp_neighbours`` limits 2-opt to so many neighbours of each stop."""
    o, edges = config.strategy.options, known_distances(points, config)
    tour = tours.improved_tour(points, int(o.get("tsp_2opt_iterations", 1000)), edges, int(o.get("tsp_neighbours", 0)))
    return tours.split_days(tour, points, config.constraints, config.distance.avg_speed_kmh, edges)


@register("cluster")
def cluster(points: DataFrame, config: PlanConfig) -> DataFrame:
    o, most, edges = config.strategy.options, config.constraints.max_daily_points, known_distances(points, config)
    active = pairs.split_outliers(points, float(o.get("outlier_threshold_km", 5.0)), edges).filter("not is_outlier")
    if o.get("cluster_method", "centroid") == "centroid":  # goes by places only
        labels = growth.grouped(active, growth.centroid_greedy(most))
    else:
        labels = growth.grouped(active, growth.chain_greedy(most, _base(config)), edges)
    return _days_of(points, labels, True, edges)


@register("dbscan")
def dbscan(points: DataFrame, config: PlanConfig) -> DataFrame:
    o, edges = config.strategy.options, known_distances(points, config)
    labels = density.road_dbscan(points, edges, float(o.get("dbscan_eps_km", 5.0)), int(o.get("dbscan_min_samples", 3)))
    return _days_of(points, labels, False, edges)


@DISTANCES.register("haversine")
def _haversine(points: DataFrame, config: PlanConfig) -> None:
    """Knows nothing: every distance is a great-circle one."""


@DISTANCES.register("road")
def _road(points: DataFrame, config: PlanConfig) -> DataFrame:
    """Road distances of ``road_edges`` (a Parquet table ``problem_id, i, j, road_km``), an option of the distance or the strategy."""
    path = config.distance.options.get("road_edges") or config.strategy.options["road_edges"]
    return points.sparkSession.read.parquet(path).select("problem_id", "i", "j", F.col("road_km").alias("km"))


@DISTANCES.register("written")
def _written(points: DataFrame, config: PlanConfig) -> DataFrame:
    """A provider's table that a plan has written down for all its steps (``distance.options.written``)."""
    return points.sparkSession.read.parquet(config.distance.options["written"])


@register("road_network")
def road_network(points: DataFrame, config: PlanConfig) -> DataFrame:
    """Density groups over the distances of the configured provider; ``road`` if the strategy has road edges."""
    o, name = config.strategy.options, config.distance.provider
    edges = DISTANCES.pick("road" if name == "haversine" and o.get("road_edges") else name)(points, config)
    labels = density.road_dbscan(points, edges, float(o.get("road_network_eps_km", 5.0)), int(o.get("road_network_min_samples", 3)))
    return _days_of(points, labels, False, edges)


@register("area_expansion")
def area_expansion(points: DataFrame, config: PlanConfig) -> DataFrame:
    o = config.strategy.options
    kernel = growth.area_expansion(float(o.get("area_expansion_threshold_km2", 50)), int(o.get("min_points_per_cluster", 3)), int(o.get("max_points_per_cluster", 50)), bool(o.get("legacy_degrees", False)))
    edges = known_distances(points, config)
    return _days_of(points, growth.grouped(points, kernel, edges), False, edges)


@register("j_style")
def j_style(points: DataFrame, config: PlanConfig) -> DataFrame:
    o = lambda k, d: config.strategy.options.get(f"j_style_{k}", d)
    kernel = growth.compact_circles(
        int(o("k_clusters", 5)), int(o("min_points", 10)), int(o("max_points", 50)), int(o("max_iterations", 50)), float(o("overlap_penalty", 5.0)), float(o("separation_weight", 0.8)),
        int(o("adjacency_k", 3)), bool(o("use_squared_overlap", True)), int(o("post_process_iterations", 20)), float(o("overlap_tolerance", 1e-6)), int(o("points_per_move", 5)),
    )
    edges = known_distances(points, config)
    return _days_of(points, growth.grouped(points, kernel, edges), False, edges)


@register("fence")
def fence(points: DataFrame, config: PlanConfig) -> DataFrame:
    return _days_of(points, slices.river(points, config.constraints.max_daily_points), True, known_distances(points, config))


@register("overnight")
def overnight_trips(points: DataFrame, config: PlanConfig) -> DataFrame:
    """Near points by the tour strategy with single-day hours; far ones in groups of two days with a night between."""
    c, base = config.constraints, _base(config)
    typed = overnight.classify(points, *(base or (None, None)), c.overnight_threshold_km)
    near, far = (typed.filter(F.col("trip_type") == k) for k in ("single_day", "overnight"))
    days = tsp(near, single_day(config))
    edges = known_distances(points, config)
    labels = growth.grouped(far, growth.chain_greedy(c.max_daily_points, base, farthest=True), edges)
    parts = overnight.halves(tours.group_tours(points, labels, sweeps=100, edges=edges))
    return overnight.renumbered(days, parts)
