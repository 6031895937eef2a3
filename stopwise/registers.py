"""Plug-ins by name: distance providers, geocoders, readers and exporters. Strategies are in :mod:`.plans.strategies`.

>>> @DISTANCES.register("mine")
... def mine(points, config): ...   # problem_id, i, j, km, or a Rule
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Register:
    """Functions of one kind by name."""

    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def register(self, name: str) -> Callable[[Callable], Callable]:
        def add(f: Callable) -> Callable:
            self.known[name] = f
            return f

        return add

    def pick(self, name: str) -> Callable[..., Any]:
        if name not in self.known:
            raise ValueError(f"no {self.kind} {name}; there are {', '.join(self.known)}")
        return self.known[name]


#: (points, config) -> ``problem_id, i, j, km`` for i < j of the pairs that it knows, or a :class:`.operators.distances.Rule` that tells them when asked, or None;
#: other pairs are great-circle.
DISTANCES = Register("distance provider")
#: (spark, config) -> ``name, lng, lat``.
GEOCODERS = Register("geocoder")
#: (spark, path) -> a table with ``row_no``.
READERS = Register("reader")
#: (plan) -> a DataFrame that holds the exported document or table.
EXPORTERS = Register("exporter")
