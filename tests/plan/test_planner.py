"""Configuration, readers and whole plans."""

import json
import os
import zipfile

import numpy as np
import pytest

from stopwise import config
from stopwise.operators import growth, tours
from stopwise.plans import catalogue, exports, fixtures, strategies
from stopwise.plans.planner import Planner
from stopwise.sources import tables

YAML = """
project: demo
base_point: {name: depot, lng: 107.08, lat: 29.85}
strategy: {name: cluster, options: {outlier_threshold_km: 0}}
constraints: {max_daily_hours: 6, max_daily_points: 3, roundtrip_overhead_min: 60}
distance: {avg_speed_kmh: ${SPEED_FOR_TEST}}
data:
  points: {file: PATH, columns: {name: addr, coordinates: xy, metadata: {note: note}}}
"""


def test_config_fills_casts_and_overrides():
    os.environ["SPEED_FOR_TEST"] = "40"
    c = config.from_text(YAML)
    assert c.distance.avg_speed_kmh == 40 and c.constraints.available_seconds == 5 * 3600
    d = config.overridden(c, {"constraints.max_daily_points": "7", "strategy.options.outlier_threshold_km": "4", "base_point.lng": "106.5"})
    assert (d.constraints.max_daily_points, d.strategy.options["outlier_threshold_km"], d.base_point.lng) == (7, 4, 106.5)
    assert c.constraints.max_daily_points == 3 and config.from_text(config.to_yaml(d)) == d
    assert config.from_text("base_point: {name: '${NOT_SET_ANYWHERE}'}").base_point.name == "${NOT_SET_ANYWHERE}"
    with pytest.raises(KeyError):
        config.overridden(c, {"constraints.nothing": "1"})


def write_sheet(path, rows):
    cell = lambda v, r, k: f'<c r="{chr(65 + k)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + k)}{r}"><v>{v}</v></c>'
    body = "".join(f'<row r="{r}">' + "".join(cell(v, r, k) for k, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_csv_and_sheet_give_the_same_points(spark, tmp_path):
    rows = [("a1", "106.9,29.8", "x"), ("", "106.9,29.8", "y"), ("b2", "bad", ""), ("nan", "1,2", ""), ("c3", "107.0,29.9", None)]
    (tmp_path / "p.csv").write_text("addr,xy,note\n" + "\n".join(f'{a},"{b}",{c or ""}' for a, b, c in rows) + "\n")
    write_sheet(tmp_path / "p.xlsx", [("addr", "xy", "note"), *rows])
    mapping = {"name": "addr", "coordinates": "xy", "metadata": {"note": "note"}}
    got = [[tuple(r) for r in tables.points(tables.read_table(spark, str(tmp_path / f)), mapping).orderBy("point_idx").select("point_idx", "point_id", "name", "lng", "lat").collect()] for f in ("p.csv", "p.xlsx")]
    assert got[0] == got[1] == [(0, "0", "a1", 106.9, 29.8), (1, "2", "b2", None, None), (2, "4", "c3", 107.0, 29.9)]


def test_plan_from_files(spark, tmp_path):
    os.environ["SPEED_FOR_TEST"] = "40"
    (tmp_path / "p.csv").write_text("addr,xy,note\n" + "\n".join(f'p{k},"{106.9 + k / 100:.3f},{29.8 + k % 3 / 100:.3f}",n{k}' for k in range(8)) + "\n")
    (tmp_path / "c.yaml").write_text(YAML.replace("PATH", str(tmp_path / "p.csv")))
    plan = Planner(spark, str(tmp_path / "c.yaml"), {"strategy.name": "tsp"}).run()
    assert plan.stops.count() == 8 and plan.unassigned.count() == 0
    assert plan.days.agg({"point_count": "max"}).first()[0] <= 3
    doc = json.loads(exports.plan_json(plan.days, plan.stops, plan.points, plan.unassigned, plan.strategy).first().plan)
    assert doc["total_points"] == 8 and "unassigned" not in doc and sum(len(d["points"]) for d in doc["days"]) == 8
    shape = json.loads(exports.geojson(plan.points, plan.stops).first().collection)
    assert len(shape["features"]) == 8 + doc["total_days"]
    with pytest.raises(ValueError):
        Planner(spark, config.PlanConfig()).run(plan.points, "no such strategy")


def test_overnight_groups_are_improved_tours_cut_in_half(spark):
    c = config.overridden(fixtures.CONFIG, {"constraints.max_daily_points": "9"})
    base = (c.base_point.lat, c.base_point.lng)
    rng, want, rows, differ = np.random.default_rng(4), set(), [], 0
    for problem in range(6):
        lat, lng = base[0] + 3 + rng.random(9) / 2, base[1] + 3 + rng.random(9) / 2
        first = growth.chain_greedy(9, base, farthest=True)(lat, lng, tours.matrix(lat, lng))[0]
        km = tours.matrix(lat[first], lng[first])
        order = tours.two_opt(km, tours.nearest_order(km, 0), 100)
        differ += order != tours.best_open(km)
        want |= {(problem, 1 if k < 4 else 2, k + 1 if k < 4 else k - 3, first[o]) for k, o in enumerate(order)}
        rows += [(problem, k, f"p{k}", float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lng, strict=True))]
    points = spark.createDataFrame(rows, "problem_id long, point_idx int, name string, lat double, lng double")
    got = strategies.STRATEGIES["overnight"](points, c).select("problem_id", "day", "stop_seq", "point_idx").collect()
    assert differ and {tuple(r) for r in got} == want


def test_all_strategies_are_registered_queries():
    assert {f"plan_{k}" for k in strategies.STRATEGIES} <= set(catalogue.queries())


def test_empty_and_single_point_problems(spark):
    points = fixtures.many(spark, "/root/testdata/sf0.001")
    for name in ("tsp", "cluster", "overnight", "dbscan", "j_style", "area_expansion", "fence", "road_network"):
        assert Planner(spark, fixtures.CONFIG).run(points.limit(0), name).stops.count() == 0
        alone = Planner(spark, fixtures.CONFIG).run(points.limit(1), name)
        assert alone.stops.count() + alone.unassigned.count() == 1


def test_survey_and_corrections(spark):
    rows = [(0, "k1", "a"), (1, "k1", "b"), (2, " ", "c")]
    t = spark.createDataFrame(rows, "row_no long, key string, org string")
    assert [(r.key, r.attrs) for r in tables.survey(t, "key", {"org": "org"}).collect()] == [("k1", {"org": "b"})]
    fixes = tables.corrections(spark.createDataFrame([(0, "old", "重庆市路"), (1, "older", "路二")], "row_no long, o string, f string"), "o", None, "重庆市")
    assert sorted((r.corrected, r.original) for r in fixes.collect()) == [("路二", "older"), ("重庆市路", "old"), ("重庆市路二", "older")]


def test_a_plan_makes_its_stops_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(points, config):
        def run(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        rows = points.selectExpr("problem_id", "1 as day", "cast(point_idx as int) as stop_seq", "point_idx").filter("point_idx > 2")
        return rows.mapInPandas(run, rows.schema)

    monkeypatch.setitem(strategies.STRATEGIES, "counted", counted)
    points = spark.createDataFrame([(0, k, "n", 107.0 + k / 100, 29.8) for k in range(10)], "problem_id long, point_idx int, name string, lng double, lat double")
    p = Planner(spark, fixtures.CONFIG).run(points, "counted")
    assert (p.days.count(), p.stops.count(), p.unassigned.count(), p.metrics.first()["total_points"]) == (1, 7, 3, 7)
    assert seen.value == 7
