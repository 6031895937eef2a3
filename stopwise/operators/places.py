"""The points of one problem by place, in blocks of neighbouring places, for kernels that take one point after the other."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable

import numpy as np


class Places:
    """Points are taken and given back; :meth:`search` looks only into blocks whose boxes may hold what is sought.

    ``x`` are the coordinates, a row for each dimension, that bounds are made from. Equal points are one place; of these
    only the lowest index that is left is ever sought. A block holds about a quarter of the root of the number of places.
    """

    def __init__(self, lat: np.ndarray, lng: np.ndarray, x: np.ndarray):
        first, self.own = np.unique(np.column_stack([lat, lng]), axis=0, return_index=True, return_inverse=True)[1:]
        self.own = self.own.ravel()
        order = np.argsort(self.own, kind="stable").tolist()
        ends = np.cumsum(np.bincount(self.own, minlength=len(first))).tolist()
        self.points = [order[a:b] for a, b in zip([0, *ends], ends)]  # by place, ascending
        self.x, self.lowest = x[:, first], np.array([p[0] for p in self.points], int)
        self.blocks, waiting = [], [np.arange(len(first))] if len(first) else []
        size = max(16, int(np.sqrt(len(first))) // 4)
        while waiting:
            places = waiting.pop()
            if len(places) <= size:
                self.blocks.append(places)
                continue
            wide = np.ptp(self.x[:, places], axis=1).argmax()
            places = places[np.argsort(self.x[wide, places], kind="stable")]
            waiting += [places[: len(places) // 2], places[len(places) // 2 :]]
        self.block, self.left = np.empty(len(first), int), len(lat)
        self.low, self.high = (np.empty((len(x), len(self.blocks))) for _ in range(2))
        self.full = np.ones(len(self.blocks), bool)
        for b, places in enumerate(self.blocks):
            self.block[places] = b
            self._fit(b)

    def _fit(self, b: int) -> None:
        places = self.blocks[b]
        self.full[b] = len(places) > 0
        if len(places):
            own = self.x[:, places]
            self.low[:, b], self.high[:, b] = own.min(1), own.max(1)

    def take(self, i: int) -> None:
        place = self.own[i]
        points, b = self.points[place], self.block[place]
        points.remove(i)
        self.left -= 1
        if points:
            self.lowest[place] = points[0]
        else:
            self.blocks[b] = self.blocks[b][self.blocks[b] != place]
            self._fit(b)

    def give_back(self, i: int) -> None:
        place = self.own[i]
        points, b = self.points[place], self.block[place]
        if not points:
            self.blocks[b] = np.append(self.blocks[b], place)
            self._fit(b)
        insort(points, i)
        self.left += 1
        self.lowest[place] = points[0]

    def search(self, bounds: np.ndarray, value: Callable[[np.ndarray], np.ndarray], within: Callable[[float], float]) -> np.ndarray:
        """The places of the blocks that may hold a value up to ``within`` of the least one; ``lowest`` has their points.

        ``value`` tells the values of places by their ``x``, and ``bounds`` has a number for each block that none of its values is under.
        """
        bounds = np.where(self.full, bounds, np.inf)
        least = value(self.x[:, self.blocks[bounds.argmin()]]).min()
        some = np.flatnonzero(~(bounds > within(least)) & self.full).tolist()  # without a number, all
        return self.blocks[some[0]] if len(some) == 1 else np.concatenate([self.blocks[b] for b in some])

    def outside(self, q: np.ndarray) -> np.ndarray:
        """Squared distances from ``q``, a column, to the boxes."""
        return (np.maximum(np.maximum(self.low - q, q - self.high), 0.0) ** 2).sum(0)

    def across(self, q: np.ndarray) -> np.ndarray:
        """Squared distances from ``q``, a column, to the farthest corners of the boxes."""
        return (np.maximum(q - self.low, self.high - q) ** 2).sum(0)
