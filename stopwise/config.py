"""Planning options, read from YAML or JSON and overridden by name."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass
class Constraints:
    max_daily_hours: float = 8.0
    max_daily_points: int = 10
    min_daily_points: int = 1
    stop_time_per_point_min: float = 15.0
    roundtrip_overhead_min: float = 0.0
    break_time_min: float = 0.0
    buffer_factor: float = 1.0
    max_daily_distance_km: float = 0.0
    overnight_threshold_km: float = 0.0
    overnight_hotel_radius_km: float = 3.0
    single_day_max_hours: float = 0.0

    @property
    def available_seconds(self) -> float:
        """Seconds in the field each day, after overhead and breaks."""
        return (self.max_daily_hours * 3600 - self.roundtrip_overhead_min * 60 - self.break_time_min * 60) / self.buffer_factor


@dataclass
class Base:
    name: str = ""
    lng: float | None = None
    lat: float | None = None


@dataclass
class Distance:
    provider: str = "haversine"
    avg_speed_kmh: float = 35.0
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class Strategy:
    name: str = "tsp"
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class Source:
    file: str = ""
    format: str = ""
    skip_rows: int = 0
    match_key: str = ""
    match_mode: str = "fuzzy"
    strip_prefix: str = ""
    original: str = ""
    corrected: str = ""
    columns: dict[str, Any] = field(default_factory=dict)


@dataclass
class Data:
    points: Source = field(default_factory=Source)
    survey: Source = field(default_factory=Source)
    corrections: Source = field(default_factory=Source)


@dataclass
class PlanConfig:
    project: str = ""
    base_point: Base = field(default_factory=Base)
    strategy: Strategy = field(default_factory=Strategy)
    constraints: Constraints = field(default_factory=Constraints)
    distance: Distance = field(default_factory=Distance)
    data: Data = field(default_factory=Data)
    export: dict[str, Any] = field(default_factory=dict)


def _filled(text: str) -> str:
    """``${NAME}`` by the environment; names that it lacks stay as they are."""
    return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], m[0]), text)


def _cast(value: Any, kind: str) -> Any:
    if value is None or not isinstance(value, str):
        return float(value) if kind.startswith("float") and isinstance(value, int) and not isinstance(value, bool) else value
    if kind.startswith("float"):
        return float(value)
    if kind.startswith("int"):
        return int(value)
    return value


def _built(kind: type, raw: dict[str, Any]) -> Any:
    """A dataclass from a mapping: unknown keys are dropped, values cast by declared type."""
    out = kind()
    for f in fields(kind):
        if f.name in raw and raw[f.name] is not None:
            now = getattr(out, f.name)
            setattr(out, f.name, _built(type(now), raw[f.name]) if is_dataclass(now) else _cast(raw[f.name], str(f.type)))
    return out


def from_dict(raw: dict[str, Any] | None) -> PlanConfig:
    return _built(PlanConfig, raw or {})


def from_text(text: str, kind: str = "yaml") -> PlanConfig:
    text = _filled(text)
    if kind == "json":
        return from_dict(json.loads(text))
    import yaml

    return from_dict(yaml.safe_load(text))


def load(path: str) -> PlanConfig:
    with open(path, encoding="utf-8") as f:
        return from_text(f.read(), "json" if path.endswith(".json") else "yaml")


def to_dict(config: PlanConfig) -> dict[str, Any]:
    return asdict(config)


def to_yaml(config: PlanConfig) -> str:
    import yaml

    return yaml.safe_dump(to_dict(config), allow_unicode=True, sort_keys=False)


def overridden(config: PlanConfig, settings: dict[str, str]) -> PlanConfig:
    """A copy with ``a.b`` set to each value, cast by declared type."""
    config = from_dict(to_dict(config))
    for path, value in settings.items():
        *way, last = path.split(".")
        at: Any = config
        for name in way:
            at = at[name] if isinstance(at, dict) else getattr(at, name)
        if isinstance(at, dict):
            now = at.get(last)
            at[last] = type(now)(value) if isinstance(now, int | float) and not isinstance(now, bool) else value
        else:
            kinds = {f.name: str(f.type) for f in fields(at)}
            if last not in kinds:
                raise KeyError(path)
            setattr(at, last, _cast(value, kinds[last]))
    return config


def summary(config: PlanConfig) -> str:
    c = config.constraints
    return (
        f"base {config.base_point.name or '-'}; strategy {config.strategy.name}; at most {c.max_daily_points} stops and "
        f"{c.max_daily_hours:g} h a day; {c.stop_time_per_point_min:g} min a stop; {config.distance.avg_speed_kmh:g} km/h; "
        f"{c.available_seconds / 60:g} min in the field"
    )


def single_day(config: PlanConfig) -> PlanConfig:
    """The options for points that need no night away: only the hours differ."""
    c = config.constraints
    return replace(config, constraints=replace(c, max_daily_hours=c.single_day_max_hours or c.max_daily_hours))
