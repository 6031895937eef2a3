"""Convex hulls, least circles and diameters of groups, by hulls that merge.

Every batch of rows is cut down to the corners of its part of each group; the corners of several batches are cut down again
by salt, then once more for the whole group. So no task sees more of a group than one batch, or the corners of some, however
many points the group has. What hull, circle and diameter need are corners alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distances import Distances
from .growth import enclosing_circle, hull, hull_area, on_hull

_ROWS = "problem_id long, label int, point_idx int, lat double, lng double"
#: Groups of a batch up to so many points are left as they are; parts of a group that are merged before the last merge.
_FEW, _SALTS = 16, 64
#: Widest angle from the middle of a group within which it is projected to a plane.
_WIDEST = np.radians(60.0)


def _tangent(lat: np.ndarray, lng: np.ndarray) -> np.ndarray | None:
    """Places in the plane that touches the globe in the middle of the points; great circles are lines there. None if they are too wide apart."""
    a, b = np.radians(lat), np.radians(lng)
    x = np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])
    middle = x.sum(axis=0)
    size = np.linalg.norm(middle)
    if size < 1e-9 or (x @ (middle / size)).min() < np.cos(_WIDEST):
        return None
    middle /= size
    east = np.cross([0.0, 0.0, 1.0] if abs(middle[2]) < 0.9 else [1.0, 0.0, 0.0], middle)
    east /= np.linalg.norm(east)
    return np.column_stack([x @ east, x @ np.cross(middle, east)]) / (x @ middle)[:, None]


def _flat_corners(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Positions on the hull in the plane of degrees, those on its edges included, so that the last merge decides alone."""
    return on_hull(np.column_stack([lng, lat]), 1e-12)


def _globe_corners(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Positions on the spherical hull, points within rounding of it included; all positions if the points are wide apart."""
    x = _tangent(lat, lng)
    return np.arange(len(lat)) if x is None else on_hull(x, 1e-13)


def corners(points: DataFrame, labels: DataFrame, on_globe: bool = False) -> DataFrame:
    """``problem_id, label, point_idx, lat, lng``: points of each group that hold the corners of its hull, in the plane of
    degrees or on the globe, few enough for one task. With equal places the lowest index stays."""
    cut = _globe_corners if on_globe else _flat_corners

    def reduced(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("point_idx", kind="stable").drop_duplicates(["lat", "lng"])
        return p if len(p) <= _FEW else p.iloc[np.sort(cut(p["lat"].to_numpy(float), p["lng"].to_numpy(float)))]

    def batchwise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, own in batch.groupby(["problem_id", "label"], sort=False):
                yield reduced(own)

    rows = points.select("problem_id", "point_idx", "lat", "lng").join(labels.select("problem_id", "point_idx", "label"), ["problem_id", "point_idx"])
    rows = rows.select("problem_id", "label", "point_idx", "lat", "lng").mapInPandas(batchwise, _ROWS)
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    return salted.groupBy("problem_id", "label", "salt").applyInPandas(lambda p: reduced(p.drop(columns="salt")), _ROWS)


def _of_groups(found: DataFrame, run: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("point_idx", kind="stable")
        return pd.DataFrame({"problem_id": [p["problem_id"].iloc[0]], "label": [p["label"].iloc[0]], **{k: [v] for k, v in run(p).items()}})

    return found.groupBy("problem_id", "label").applyInPandas(one, "problem_id long, label int, " + schema)


def circle_of_groups(points: DataFrame, labels: DataFrame) -> DataFrame:
    """``problem_id, label, lat, lng, r``: the least enclosing circle of each group, in degrees."""

    def run(p: pd.DataFrame) -> dict:
        return dict(zip(("lat", "lng", "r"), (round(v, 9) for v in enclosing_circle(p[["lat", "lng"]].to_numpy(float))), strict=True))

    return _of_groups(corners(points, labels), run, "lat double, lng double, r double")


def hulls(points: DataFrame, labels: DataFrame) -> DataFrame:
    """``problem_id, label, corners, area_km2``: the convex hull of each group, anticlockwise from its westmost corner.

    The area is taken in a plane through the mean of all points of the group.
    """

    def run(p: pd.DataFrame) -> dict:
        lat, lng = p["lat"].to_numpy(float), p["lng"].to_numpy(float)
        x = np.column_stack([lng * 111.0 * np.cos(np.radians(p["mean_lat"].iloc[0])), lat * 111.0])
        x -= x[0]
        return {"corners": [{"lat": float(a), "lng": float(b)} for b, a in hull(np.column_stack([lng, lat]))], "area_km2": round(hull_area(x), 6)}

    mean = points.select("problem_id", "point_idx", "lat").join(labels.select("problem_id", "point_idx", "label"), ["problem_id", "point_idx"])
    mean = mean.groupBy("problem_id", "label").agg(F.avg("lat").alias("mean_lat"))
    found = corners(points, labels).join(mean, ["problem_id", "label"])
    return _of_groups(found, run, "corners array<struct<lat: double, lng: double>>, area_km2 double")


def antipodal(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of corners of a convex polygon (anticlockwise) that parallel lines touch, by rotating calipers."""
    n = len(x)
    if n < 3:
        yield from [(0, 1)] if n == 2 else []
        return
    area = lambda a, b, c: (x[b][0] - x[a][0]) * (x[c][1] - x[a][1]) - (x[b][1] - x[a][1]) * (x[c][0] - x[a][0])
    k = 1
    for i in range(n):
        after, steps = (i + 1) % n, 0
        while steps < n and area(i, after, (k + 1) % n) > area(i, after, k):
            yield i, k
            k, steps = (k + 1) % n, steps + 1
        yield i, k
        yield after, k


def diameter(lat: np.ndarray, lng: np.ndarray) -> float:
    """The largest great-circle distance of some points, in km.

    The calipers' pairs of the hull in the touching plane give a distance that is reached. A pair can only be farther apart if
    its ways from the middle of the group sum up to more, so few corners are left to be compared, a row of distances at a time.
    """
    if len(lat) < 2:
        return 0.0
    km, best = Distances(lat, lng), 0.0
    x = _tangent(lat, lng)
    if x is not None:
        ring = on_hull(x)
        best = max((km[int(ring[a]), int(ring[b])] for a, b in antipodal(x[ring])), default=0.0)
    middle = Distances(np.append(lat, (lat.min() + lat.max()) / 2), np.append(lng, (lng.min() + lng.max()) / 2))[len(lat)][:-1]
    left = np.flatnonzero(middle + middle.max() >= best - 1e-5)
    for a in left:
        best = max(best, float(km[int(a), left].max()))
    return best


def diameters(points: DataFrame, labels: DataFrame) -> DataFrame:
    """``problem_id, label, max_km``: the largest distance within each group, 0 for a single place; no pairs are made."""

    def run(p: pd.DataFrame) -> dict:
        p = p.drop_duplicates(["lat", "lng"])
        lat, lng = p["lat"].to_numpy(float), p["lng"].to_numpy(float)
        own = _globe_corners(lat, lng)
        return {"max_km": diameter(lat[own], lng[own])}

    return _of_groups(corners(points, labels, on_globe=True), run, "max_km double")
