"""Distances between the points of one problem, inside a task: great-circle ones, and a provider's where its table has them.

A provider's table is sparse: ``problem_id, i, j, km`` for i < j of the pairs that it knows. All other pairs are great-circle.
A problem's task gets its coordinates and its part of the table; a row of distances is made when it is asked for, so memory is
linear in points and known pairs. A provider that can tell any pair by itself gives a :class:`Rule` in place of a table; then no
pair is written or sent anywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, PLACES


@dataclass(frozen=True)
class Rule:
    """What a provider knows, told pair by pair when asked.

    ``knows(i, j)`` and ``km(i, j, circle_km)``, for indices i < j, are of plain operators, so that they take columns and arrays alike;
    km is rounded to ``places``, no fewer than those of great-circle distances. Pairs that it does not know are great-circle. No distance is shorter than ``least`` times the
    great-circle one; 0 where that is not known.
    """

    knows: Callable[[Any, Any], Any]
    km: Callable[[Any, Any, Any], Any]
    least: float = 0.0
    places: int = 8

    def column(self, i: Column, j: Column, circle: Column) -> Column:
        """The km of pairs i < j; null where i, j or the great-circle distance is."""
        i, j = i.cast("long"), j.cast("long")
        return F.when(self.knows(i, j), F.round(self.km(i, j, circle), self.places)).otherwise(circle)

    def array(self, i: np.ndarray | int, j: np.ndarray | int, circle: np.ndarray) -> np.ndarray:
        low, high = np.minimum(i, j), np.maximum(i, j)
        return np.where((low != high) & self.knows(low, high), np.round(self.km(low, high, circle), self.places), circle)


class Distances:
    """``km[a]``: from position a to all; ``km[a, b]``: to positions b (one or an array). ``rule`` goes by the indices ``idx``."""

    def __init__(
        self, lat: np.ndarray, lng: np.ndarray, i: np.ndarray | None = None, j: np.ndarray | None = None, km: np.ndarray | None = None,
        rule: Rule | None = None, idx: np.ndarray | None = None,
    ):
        self.rule, self.idx = rule, None if rule is None else np.asarray(idx, np.int64)
        self.lat, self.lng = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lng, float))
        self.cos = np.cos(self.lat)
        ends = (np.concatenate([i, j]), np.concatenate([j, i])) if i is not None and len(i) else (np.empty(0, int), np.empty(0, int))
        order = np.lexsort((ends[1], ends[0]))
        self._to, self._km = ends[1][order], (np.concatenate([km, km])[order] if len(order) else np.empty(0))
        self._from = np.searchsorted(ends[0][order], np.arange(len(self.lat) + 1))

    def __len__(self) -> int:
        return len(self.lat)

    def plain(self) -> bool:
        """Whether no distance is a provider's."""
        return not len(self._to) and self.rule is None

    def least(self) -> float:
        """No distance is shorter than so many times the great-circle one; 0 if that is not known."""
        return (1.0 if self.rule is None else min(1.0, self.rule.least)) if not len(self._to) else 0.0

    def part(self, low: int, high: int) -> Distances:
        """Those among positions ``low`` to ``high``."""
        own, out = slice(self._from[low], self._from[high]), object.__new__(Distances)
        out.lat, out.lng, out.cos = self.lat[low:high], self.lng[low:high], self.cos[low:high]
        out.rule, out.idx = self.rule, None if self.rule is None else self.idx[low:high]
        inside = (self._to[own] >= low) & (self._to[own] < high)
        out._to, out._km = self._to[own][inside] - low, self._km[own][inside]
        out._from = np.append(0, np.cumsum(inside))[self._from[low : high + 1] - self._from[low]]
        return out

    def vectors(self) -> np.ndarray:
        """The points on a globe of radius 1."""
        return np.column_stack([self.cos * np.cos(self.lng), self.cos * np.sin(self.lng), np.sin(self.lat)])

    def known(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """What the table has from position a: positions in ascending order and km."""
        own = slice(self._from[a], self._from[a + 1])
        return self._to[own], self._km[own]

    def _circle(self, a: int, to: np.ndarray | slice) -> np.ndarray:
        h = np.sin((self.lat[to] - self.lat[a]) / 2) ** 2 + self.cos[a] * self.cos[to] * np.sin((self.lng[to] - self.lng[a]) / 2) ** 2
        return np.round(2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h))), PLACES)

    def to(self, lat: float, lng: float, to: np.ndarray | slice = slice(None)) -> np.ndarray:  # noqa: B008
        """Great-circle distances to any place, from positions ``to``."""
        lat, lng = np.radians(lat), np.radians(lng)
        h = np.sin((self.lat[to] - lat) / 2) ** 2 + np.cos(lat) * self.cos[to] * np.sin((self.lng[to] - lng) / 2) ** 2
        return np.round(2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h))), PLACES)

    def __getitem__(self, key: int | tuple[int, np.ndarray | int]) -> np.ndarray | float:
        if not isinstance(key, tuple):
            row = self._circle(int(key), slice(None))
            if self.rule is not None:
                return self.rule.array(self.idx[int(key)], self.idx, row)
            to, km = self.known(int(key))
            row[to] = km
            return row
        a, b = int(key[0]), np.atleast_1d(key[1])
        row, (to, km) = self._circle(a, b), self.known(a)
        if self.rule is not None:
            row = self.rule.array(self.idx[a], self.idx[b], row)
        if len(to):
            at = np.minimum(np.searchsorted(to, b), len(to) - 1)
            row = np.where(to[at] == b, km[at], row)
        return row if np.ndim(key[1]) else float(row[0])

    def matrix(self) -> np.ndarray:
        """All distances, n x n."""
        return np.array([self[a] for a in range(len(self))]).reshape(len(self), len(self))


def per_problem(points: DataFrame, edges: DataFrame | Rule | None, keys: list[str], run: Callable[[pd.DataFrame, Distances], pd.DataFrame], schema: str, order: tuple[str, ...] = ("point_idx",)) -> DataFrame:
    """Runs ``run(points in order, distances)`` for each group of ``keys``; ``edges`` has the keys, ``i, j, km``, or is a rule."""
    rule = edges if isinstance(edges, Rule) else None

    def alone(p: pd.DataFrame) -> pd.DataFrame:
        return both(p, None)

    def both(p: pd.DataFrame, known: pd.DataFrame | None) -> pd.DataFrame:
        if p.empty:  # pairs of a problem without points
            return pd.DataFrame({c.split(" ")[0]: [] for c in schema.split(", ")})
        p = p.sort_values(list(order), kind="stable").reset_index(drop=True)
        lat, lng = p["lat"].to_numpy(float), p["lng"].to_numpy(float)
        if known is None or known.empty:
            return run(p, Distances(lat, lng, rule=rule, idx=p["point_idx"].to_numpy()))
        places = pd.Index(p["point_idx"])
        i, j, km = places.get_indexer(known["i"]), places.get_indexer(known["j"]), known["km"].to_numpy(float)
        met = (i >= 0) & (j >= 0) & (i != j)
        return run(p, Distances(lat, lng, i[met], j[met], km[met]))

    # small rows, long work: by a number of partitions that is given, AQE does not lay all problems into one task
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = points.repartition(parts, *keys)
    if edges is None or rule is not None:
        return points.groupBy(*keys).applyInPandas(alone, schema)
    known = edges.select(*[F.col(k).alias(f"own_{k}") for k in keys], "i", "j", "km")  # a table made from the same points has the same columns
    known = known.repartition(parts, *[f"own_{k}" for k in keys])
    return points.groupBy(*keys).cogroup(known.groupBy(*[f"own_{k}" for k in keys])).applyInPandas(both, schema)
