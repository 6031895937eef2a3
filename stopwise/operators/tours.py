"""Tours and day plans.

Order is sequential inside a problem, so a problem is one task's group; problems are some tens to thousands of points and
are spread over the cluster. Coordinates and a provider's known distances are sent; the kernels below see one problem each and
make a row of distances at a time. Splitting a tour into days is a fold in Catalyst, and everything after it is relational.
``edges`` is a provider's sparse table everywhere (``problem_id, i, j, km`` for i < j), its rule, or None for great-circle distances.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Constraints
from ..functions.geo import EARTH_KM, PLACES, drive_seconds
from . import shared
from .distances import Distances, Rule, per_problem
from .pairs import legs

STOPS = "problem_id long, stop_seq int, point_idx int"


#: Rows of distances: a matrix, or what makes them when asked.
Km = np.ndarray | Distances


def matrix(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """All great-circle distances of a problem, in km."""
    return Distances(lat, lng).matrix()


def nearest_order(km: Km, start: int = 0) -> list[int]:
    """Always the nearest point not yet visited; ties go to the lowest index.

    Where no distance is shorter than a share of the great-circle one, those are worked out that straight lines through the earth do
    not show to be longer than that of the point next by such a line.
    """
    order, left = [start], np.ones(len(km), bool)
    left[start] = False
    least = km.least() if isinstance(km, Distances) else 0.0
    if least <= 0:
        while len(rest := np.flatnonzero(left)):
            order.append(int(rest[km[order[-1], rest].argmin()]))
            left[order[-1]] = False
        return order
    at = km.vectors()
    rest = np.flatnonzero(left)
    held = np.ascontiguousarray(at[rest].T)
    while len(order) < len(km):
        alike = np.where(left[rest], at[order[-1]] @ held, -2.0)  # cosines
        within = (km[order[-1], int(rest[alike.argmax()])] + 1e-3) / (EARTH_KM * least)  # rounding is under half of that
        some = rest[(alike >= 1.0 - within * within / 2.0) & left[rest]]
        some = some if len(some) else rest[left[rest]]  # a place that is no number
        order.append(int(some[km[order[-1], some].argmin()]))
        left[order[-1]] = False
        if 2 * (len(km) - len(order)) < len(rest):
            rest = rest[left[rest]]
            held = np.ascontiguousarray(at[rest].T)
    return order


def two_opt(km: Km, order: list[int], sweeps: int) -> list[int]:
    """Reversals that shorten the closed tour, first improvement, the first stop fixed.

    For each stop all later ones are looked at in order, as two rows of distances; memory is linear in the stops. Where no
    distance is shorter than a share of the great-circle one, those that straight lines through the earth show to be too long are not worked out.
    """
    tour, n = np.array(order, int), len(order)
    least = km.least() if isinstance(km, Distances) else 0.0
    leg = np.array([km[a, b] for a, b in zip(tour, np.roll(tour, -1), strict=True)]) if n > 2 else None
    at = np.ascontiguousarray(km.vectors()[np.append(tour, tour[0])].T) if n > 2 and least > 0 else None
    # a shorter pair of legs has one that is shorter than what it takes the place of: the cosine of that, with room for rounding
    alike = (lambda x: 1.0 - ((x + 1e-3) / (EARTH_KM * least)) ** 2 / 2.0) if at is not None else None
    most = alike(leg) if at is not None else None
    for _ in range(sweeps if n > 2 else 0):
        better = False
        for i in range(1, n - 1):
            j = i + 1
            while j < n:
                a, b = tour[i - 1], tour[i]
                asked = np.arange(n - j)
                if at is not None:
                    cos = at[:, i - 1 : i + 1].T @ at[:, j:]
                    asked = np.flatnonzero((cos[0, :-1] >= most[i - 1]) | (cos[1, 1:] >= most[j:]))
                    line = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos[0, asked])) + np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos[1, asked + 1]))
                    asked = asked[EARTH_KM * least * line < leg[i - 1] + leg[j + asked] + 1e-3]  # rounding is under half of that
                if not len(asked):
                    break
                from_a, from_b = km[a, tour[j + asked]], km[b, tour[(j + asked + 1) % n]]
                shorter = np.flatnonzero(from_a + from_b < leg[i - 1] + leg[j + asked] - 1e-9)
                if not len(shorter):
                    break
                k = int(shorter[0])
                j += int(asked[k])
                tour[i : j + 1] = tour[i : j + 1][::-1]
                leg[i:j] = leg[i:j][::-1]
                leg[i - 1], leg[j] = from_a[k], from_b[k]
                if at is not None:
                    at[:, i : j + 1] = at[:, i : j + 1][:, ::-1].copy()
                    most[i:j] = most[i:j][::-1]
                    most[i - 1], most[j] = alike(leg[i - 1]), alike(leg[j])
                better, j = True, j + 1
        if not better:
            break
    return tour.tolist()


def two_opt_near(km: Km, order: list[int], neighbours: int) -> list[int]:
    """Reversals that shorten the closed tour, each stop with its nearest ``neighbours`` only; the first stop stays first.

    Stops wait in a queue; one that nothing improves is not looked at again until a leg of it changes. Memory is points
    times neighbours. A reversal turns the shorter side, so the tour is turned to its first stop in the end.
    """
    n, k = len(order), min(neighbours, len(order) - 1)
    if n < 4:
        return list(order)
    near, away = np.empty((n, k), int), np.empty((n, k))
    for a in range(n):
        row = km[a]
        row = row.copy() if isinstance(row, np.ndarray) else row
        row[a] = np.inf
        own = np.argpartition(row, k - 1)[:k]
        near[a] = own[np.lexsort((own, row[own]))]
        away[a] = row[near[a]]
    tour, at = list(order), [0] * n
    for place, p in enumerate(tour):
        at[p] = place

    def turn(i: int, j: int) -> None:
        """Reverses places i to j, going round the end if j < i; the shorter of that and the rest."""
        size = (j - i) % n + 1
        if 2 * size > n:
            i, j, size = (j + 1) % n, (i - 1) % n, n - size
        for _ in range(size // 2):
            tour[i], tour[j] = tour[j], tour[i]
            at[tour[i]], at[tour[j]] = i, j
            i, j = (i + 1) % n, (j - 1) % n

    waiting, queued = deque(tour), [True] * n
    while waiting:
        a = waiting.popleft()
        queued[a] = False
        for step in (1, -1):  # the leg to the next stop, then that from the last
            b = tour[(at[a] + step) % n]
            own, found = km[a, b], None
            for c, ac in zip(near[a].tolist(), away[a].tolist(), strict=True):
                if ac >= own:
                    break
                d = tour[(at[c] + step) % n]
                if c != b and d != a and ac + km[b, d] < own + km[c, d] - 1e-9:
                    found = c, d
                    break
            if found:
                c, d = found
                # a-b and c-d become a-c and b-d
                turn(*((at[b], at[c]) if step == 1 else (at[a], at[d])))
                for p in (a, b, c, d):
                    if not queued[p]:
                        queued[p] = True
                        waiting.append(p)
                break
    first = at[order[0]]
    return tour[first:] + tour[:first]


def open_length(km: Km, order: list[int]) -> float:
    return float(sum(km[a, b] for a, b in zip(order, order[1:], strict=False)))


def best_open(km: Km) -> list[int]:
    """The shortest open path: exhaustive up to five points, else the best nearest-neighbour tour over all starts."""
    n = len(km)
    if n <= 2:
        return list(range(n))
    km = km.matrix() if isinstance(km, Distances) else km
    if n > 5:
        return min((nearest_order(km, s) for s in range(n)), key=lambda o: round(open_length(km, o), PLACES))
    tries = _every_order(n)
    away = km[tries[:, 0], tries[:, 1]]
    for k in range(1, n - 1):
        away = away + km[tries[:, k], tries[:, k + 1]]
    some = np.flatnonzero(away <= away.min() + 2 * 10.0**-PLACES)  # no others are rounded to the least
    return tries[min(some, key=lambda t: round(float(away[t]), PLACES))].tolist()


@lru_cache
def _every_order(n: int) -> np.ndarray:
    return np.array(list(permutations(range(n))))


def _ordered(points: DataFrame, edges: DataFrame | Rule | None, order: Callable[[Distances], list[int]]) -> DataFrame:
    def run(p: pd.DataFrame, km: Distances) -> pd.DataFrame:
        return pd.DataFrame({"problem_id": p["problem_id"].iloc[0], "stop_seq": range(1, len(p) + 1), "point_idx": p["point_idx"].to_numpy()[order(km)]})

    return per_problem(points.select("problem_id", "point_idx", "lat", "lng"), edges, ["problem_id"], run, STOPS)


def nearest_tour(points: DataFrame, edges: DataFrame | Rule | None = None) -> DataFrame:
    """``problem_id, stop_seq, point_idx`` from the lowest index on."""
    return _ordered(points, edges, nearest_order)


def improved_tour(points: DataFrame, sweeps: int = 1000, edges: DataFrame | Rule | None = None, neighbours: int = 0) -> DataFrame:
    """The nearest tour, then 2-opt: over all pairs of stops, or with ``neighbours``, of each stop and its nearest."""
    return _ordered(points, edges, lambda km: two_opt_near(km, nearest_order(km), neighbours) if neighbours > 0 and sweeps > 0 else two_opt(km, nearest_order(km), sweeps))


#: Groups that a call of the grouped map of :func:`group_tours` takes: most are of a few points.
_TOGETHER = 32


def group_tours(points: DataFrame, labels: DataFrame, whole: bool = True, sweeps: int = 0, edges: DataFrame | Rule | None = None) -> DataFrame:
    """``problem_id, label, stop_seq, point_idx``: each group's own path, best open (``whole``) or nearest from its first.

    With ``sweeps``, the nearest path from the first point, then 2-opt.
    """

    def run(p: pd.DataFrame, km: Distances) -> pd.DataFrame:
        label, first = p["label"].to_numpy(), np.flatnonzero(p["label"].diff().to_numpy() != 0)
        found, seq = np.empty(len(p), int), np.empty(len(p), int)
        for low, high in zip(first, np.append(first[1:], len(p)), strict=True):
            own = km.part(low, high)
            order = two_opt(own, nearest_order(own), sweeps) if sweeps else best_open(own) if whole else nearest_order(own)
            found[low:high], seq[low:high] = low + np.array(order, int), range(1, high - low + 1)
        return pd.DataFrame({"problem_id": p["problem_id"].to_numpy(), "label": label, "stop_seq": seq, "point_idx": p["point_idx"].to_numpy()[found]})

    table = edges is not None and not isinstance(edges, Rule)
    labels = shared.cut(labels, "labels") if table else labels  # read three times, and known to be small
    seq = F.col("seq") if "seq" in labels.columns else F.lit(0).alias("seq")
    rows = points.select("problem_id", "point_idx", "lat", "lng").join(labels.select("problem_id", "point_idx", "label", seq), ["problem_id", "point_idx"])
    if table:  # those inside a group
        i, j = (labels.select("problem_id", F.col("point_idx").alias(t), F.col("label").alias(f"label_{t}")) for t in "ij")
        edges = edges.join(i, ["problem_id", "i"]).join(j, ["problem_id", "j"]).filter("label_i = label_j").withColumnRenamed("label_i", "label")
        edges = edges.withColumn("part", F.floor(F.col("label") / _TOGETHER))
    rows = rows.withColumn("part", F.floor(F.col("label") / _TOGETHER))
    return per_problem(rows, edges, ["problem_id", "part"], run, "problem_id long, label int, stop_seq int, point_idx int", ("label", "seq", "point_idx"))


# Constraints as column builders: what a day may hold once a stop is added.


def fits_count(count: Column, most: int) -> Column:
    return count + 1 <= most


def fits_distance(total_km: Column, most_km: float) -> Column:
    return (total_km <= most_km) if most_km > 0 else F.lit(True)


def fits_time(seconds: Column, available: float) -> Column:
    return seconds <= available


def split_days(stops: DataFrame, points: DataFrame, limits: Constraints, speed_kmh: float = 35.0, edges: DataFrame | Rule | None = None) -> DataFrame:
    """``problem_id, day, stop_seq, point_idx``: a tour cut into days.

    A day's first stop is always taken; the next goes to a new day when the day has its most stops, or would drive too
    far, or would take too long. The drive between days is not counted. The tour of a problem is folded as an array of
    its legs, in order; the fold is linear in its stops.
    """
    # the tour as if on one day, for its legs
    one = legs(stops.withColumn("day", F.lit(1)), points, edges)
    before = Window.partitionBy("problem_id").orderBy("stop_seq")
    one = one.select("problem_id", "stop_seq", "point_idx", F.coalesce(F.lag("leg_km").over(before), F.lit(0.0)).alias("km"))
    tour = one.groupBy("problem_id").agg(F.sort_array(F.collect_list(F.struct("stop_seq", "point_idx", "km"))).alias("tour"))
    stay, zero = limits.stop_time_per_point_min * 60.0, F.lit(0.0)
    start = F.struct(F.lit(0).alias("day"), F.lit(0).alias("n"), zero.alias("km"), zero.alias("sec"), F.array().cast("array<int>").alias("days"))

    def step(acc: Column, x: Column) -> Column:
        km, sec = acc["km"] + x["km"], acc["sec"] + drive_seconds(x["km"], speed_kmh) + stay
        room = (acc["day"] > 0) & fits_count(acc["n"], limits.max_daily_points) & fits_distance(km, limits.max_daily_distance_km) & fits_time(sec, limits.available_seconds)
        day = F.when(room, acc["day"]).otherwise(acc["day"] + 1)
        return F.struct(
            day.alias("day"),
            F.when(room, acc["n"] + 1).otherwise(1).alias("n"),
            F.when(room, km).otherwise(0.0).alias("km"),
            F.when(room, sec).otherwise(F.lit(stay)).alias("sec"),
            F.concat(acc["days"], F.array(day)).alias("days"),
        )

    dealt = tour.select("problem_id", "tour", F.aggregate("tour", start, step, lambda acc: acc["days"]).alias("days"))
    rows = dealt.select("problem_id", F.explode(F.arrays_zip("tour", "days")).alias("x")).select("problem_id", F.col("x.days").alias("day"), F.col("x.tour.stop_seq").alias("at"), F.col("x.tour.point_idx").alias("point_idx"))
    own = Window.partitionBy("problem_id", "day").orderBy("at")
    return rows.select("problem_id", "day", F.row_number().over(own).alias("stop_seq"), "point_idx")


def day_rollup(stops: DataFrame, points: DataFrame, limits: Constraints, speed_kmh: float = 35.0, overhead: bool = True, edges: DataFrame | Rule | None = None) -> DataFrame:
    """One row per day: ``point_count, drive_distance_km, drive_time_min, stop_time_min, total_time_hours``, each rounded."""
    sums = legs(stops, points, edges).groupBy("problem_id", "day").agg(F.count(F.lit(1)).alias("point_count"), F.round(F.sum("leg_km"), PLACES).alias("km"))
    sec = drive_seconds(F.col("km"), speed_kmh)
    stay = F.col("point_count") * limits.stop_time_per_point_min
    extra = limits.roundtrip_overhead_min if overhead else 0.0
    return sums.select(
        "problem_id", "day", "point_count", F.round("km", 1).alias("drive_distance_km"), F.round(sec / 60, 1).alias("drive_time_min"),
        F.round(stay, 1).alias("stop_time_min"), F.round((sec / 60 + stay + extra) / 60, 1).alias("total_time_hours"),
    )


def plan_metrics(days: DataFrame, limits: Constraints, keys: tuple[str, ...] = ("problem_id",)) -> DataFrame:
    """Totals of a plan; distances and hours are sums of the days' rounded figures."""
    n = F.count(F.lit(1))
    return days.groupBy(*keys).agg(
        n.alias("total_days"), F.sum("point_count").alias("total_points"), F.round(F.sum("drive_distance_km"), 6).alias("total_distance_km"),
        F.round(F.sum("total_time_hours"), 6).alias("total_hours"), F.max("point_count").alias("max_day_points"),
        F.round(F.sum("drive_distance_km") / n, 6).alias("avg_day_distance"), F.count_if(F.col("total_time_hours") > limits.max_daily_hours).alias("overtime_days"),
    )


def with_totals(days: DataFrame) -> DataFrame:
    """The days of each problem and a row of totals (``day`` null)."""
    sums = [F.sum("point_count").alias("point_count"), *[F.round(F.sum(c), 6).alias(c) for c in ("drive_distance_km", "total_time_hours")]]
    return days.select("problem_id", "day", "point_count", "drive_distance_km", "total_time_hours").unionByName(days.groupBy("problem_id").agg(*sums).withColumn("day", F.lit(None).cast("int")))


def roles(stops: DataFrame) -> DataFrame:
    """Adds ``role``: start, stop n, return."""
    day = Window.partitionBy("problem_id", "day")
    last = F.count(F.lit(1)).over(day)
    kind = F.when(F.col("stop_seq") == 1, "start").when(F.col("stop_seq") == last, "return").otherwise(F.concat(F.lit("stop "), (F.col("stop_seq") - 1).cast("string")))
    return stops.withColumn("role", kind)


def actual_totals(stops: DataFrame, road: DataFrame, base_idx: int) -> DataFrame:
    """Day totals over base, stops, base by road legs (``problem_id, i, j, road_km``); a leg that failed counts 0."""
    day = Window.partitionBy("problem_id", "day").orderBy("stop_seq")
    here = stops.select("problem_id", "day", "stop_seq", F.coalesce(F.lag("point_idx").over(day), F.lit(base_idx)).alias("i"), F.col("point_idx").alias("j"))
    back = stops.groupBy("problem_id", "day").agg((F.max("stop_seq") + 1).alias("stop_seq"), F.max_by("point_idx", "stop_seq").alias("i")).withColumn("j", F.lit(base_idx))
    both = road.select("problem_id", "i", "j", "road_km").union(road.select("problem_id", F.col("j").alias("i"), F.col("i").alias("j"), "road_km"))
    way = here.unionByName(back).join(both, ["problem_id", "i", "j"], "left")
    return way.groupBy("problem_id", "day").agg(F.round(F.sum(F.coalesce("road_km", F.lit(0.0))), 6).alias("road_km"), F.count_if(F.col("road_km").isNull()).alias("failed_legs"))
