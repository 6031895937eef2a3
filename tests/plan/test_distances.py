"""Distances by a provider's table, and tours in linear memory."""

import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stopwise import config
from stopwise.functions import geo
from stopwise.operators import density, growth, pairs, tours
from stopwise.operators.distances import Distances, Rule
from stopwise.plans import catalogue, fixtures
from stopwise.plans.planner import Planner
from stopwise.registers import DISTANCES


def some_points(rng, n, problems=1):
    rows = [(p, k, f"p{k}", round(29.7 + rng.random() / 4, 5), round(106.7 + rng.random() / 2, 5)) for p in range(problems) for k in range(n)]
    return pd.DataFrame(rows, columns=["problem_id", "point_idx", "name", "lat", "lng"])


def some_edges(rng, points, share):
    out = []
    for p, own in points.groupby("problem_id"):
        idx = sorted(own["point_idx"])
        out += [(p, i, j, round(rng.random() * 60, 3)) for i in idx for j in idx if i < j and rng.random() < share]
    return pd.DataFrame(out, columns=["problem_id", "i", "j", "km"]).astype({"problem_id": "int64", "i": "int32", "j": "int32", "km": "float64"})


def full(points, edges):
    """{(problem, i, j): km} both ways."""
    known = {(e.problem_id, e.i, e.j): e.km for e in edges.itertuples()} if edges is not None else {}
    out = {}
    for p, own in points.groupby("problem_id"):
        km = tours.matrix(own["lat"].to_numpy(), own["lng"].to_numpy())
        for a, i in enumerate(own["point_idx"]):
            for b, j in enumerate(own["point_idx"]):
                if i != j:
                    out[p, i, j] = known.get((p, min(i, j), max(i, j)), km[a, b])
    return out


def test_rows_of_distances_equal_the_matrix():
    rng = random.Random(1)
    pts = some_points(rng, 30)
    edges = some_edges(rng, pts, 0.2)
    km = Distances(pts["lat"], pts["lng"], edges["i"].to_numpy(), edges["j"].to_numpy(), edges["km"].to_numpy())
    want = full(pts, edges)
    m = km.matrix()
    assert all(m[i, j] == want[0, i, j] for i in range(30) for j in range(30) if i != j) and (m == m.T).all() and (np.diag(m) == 0).all()
    assert all((km[a] == m[a]).all() and (km[a, np.array([3, 9, 2])] == m[a, [3, 9, 2]]).all() and km[a, 4] == m[a, 4] for a in range(30))
    assert len(Distances(np.array([]), np.array([])).matrix()) == 0


def slow_two_opt(km, order, sweeps):
    tour, n = list(order), len(order)
    for _ in range(sweeps):
        better = False
        for i in range(1, n - 1):
            for j in range(i + 1, n):
                a, b, c, d = tour[i - 1], tour[i], tour[j], tour[(j + 1) % n]
                if km[a, c] + km[b, d] < km[a, b] + km[c, d] - 1e-9:
                    tour[i : j + 1] = tour[i : j + 1][::-1]
                    better = True
        if not better:
            break
    return tour


def test_two_opt_takes_the_same_steps_as_the_double_loop():
    rng = random.Random(2)
    for n in (1, 2, 3, 4, 5, 9, 40):
        pts = some_points(rng, n)
        for share in (0, 0.3):
            e = some_edges(rng, pts, share)
            km = Distances(pts["lat"], pts["lng"], e["i"].to_numpy(), e["j"].to_numpy(), e["km"].to_numpy())
            first = tours.nearest_order(km)
            for sweeps in (0, 1, 1000):
                assert tours.two_opt(km, first, sweeps) == slow_two_opt(km.matrix(), first, sweeps)


def test_neighbour_lists_in_linear_memory_never_lengthen():
    rng = random.Random(3)
    closed = lambda km, o: tours.open_length(km, [*o, o[0]])
    for n, share in ((1, 0), (3, 0), (4, 0), (60, 0.3), (200, 0)):
        pts = some_points(rng, n)
        e = some_edges(rng, pts, share)
        km = Distances(pts["lat"], pts["lng"], e["i"].to_numpy(), e["j"].to_numpy(), e["km"].to_numpy())
        first = tours.nearest_order(km)
        better = tours.two_opt_near(km, first, 8)
        assert sorted(better) == list(range(n)) and better[0] == 0 and closed(km, better) <= closed(km, first) + 1e-6
    pts = some_points(rng, 2500)
    km = Distances(pts["lat"], pts["lng"])
    tracemalloc.start()
    first = tours.nearest_order(km)
    better = tours.two_opt_near(km, first, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(better) == list(range(2500)) and closed(km, better) < 0.95 * closed(km, first)
    assert peak < 2500 * 2500  # bytes: an eighth of a matrix


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_nearest_reach_legs_and_groups_by_a_sparse_table(spark, share):
    rng = random.Random(4)
    pts = some_points(rng, 25, 2)
    e = some_edges(rng, pts, share)
    want = full(pts, e)
    points = spark.createDataFrame(pts, "problem_id long, point_idx int, name string, lat double, lng double")
    stray = [(9, 1, 2, 0.1), (0, 3, 999, 0.1)]  # of no point
    edges = spark.createDataFrame([tuple(r) for r in e.itertuples(index=False)] + stray, "problem_id long, i int, j int, km double")
    got = {(r.problem_id, r.point_idx): (r.nearest_km, r.nearest_idx) for r in pairs.nearest(points, edges).collect()}
    assert got == {(p, i): min((want[p, i, j], j) for j in range(25) if j != i) for p in range(2) for i in range(25)}
    near = {(r.problem_id, r.i, r.j): r.km for r in pairs.reach(points, 9.0, edges).collect()}
    assert near == {k: v for k, v in want.items() if k[1] < k[2] and v <= 9.0}
    stops = points.select("problem_id", (F.col("point_idx") % 3).alias("day"), (F.col("point_idx") % 7 * 100 + F.col("point_idx")).alias("stop_seq"), "point_idx")
    legs = pairs.legs(stops, points, edges).collect()
    by_day = {}
    for r in sorted(legs, key=lambda r: r.stop_seq):
        by_day.setdefault((r.problem_id, r.day), []).append(r)
    for (p, _), own in by_day.items():
        assert [r.leg_km for r in own] == [want[p, a.point_idx, b.point_idx] for a, b in zip(own, own[1:], strict=False)] + [0.0]
    labels = {(r.problem_id, r.point_idx): r.label for r in growth.grouped(points, growth.chain_greedy(5), edges).collect()}
    for p in range(2):
        km = np.array([[0.0 if i == j else want[p, i, j] for j in range(25)] for i in range(25)])
        own = pts[pts["problem_id"] == p]
        for label, members in enumerate(growth.chain_greedy(5)(own["lat"].to_numpy(), own["lng"].to_numpy(), km)):
            assert all(labels[p, m] == label for m in members)
    assert density.road_dbscan(points, edges, 9.0, 3).count() == 50


def test_a_provider_reaches_every_strategy(spark):
    """All distances the same but those to point 0, which are short: plans must follow."""
    points = fixtures.many(spark, "/root/testdata/sf0.001")

    @DISTANCES.register("flat_for_test")
    def flat(points, config):
        return pairs.pairs(points).select("problem_id", "i", "j", (F.col("km") * 0 + 4.0).alias("km"))

    c = config.overridden(fixtures.CONFIG, {"distance.provider": "flat_for_test"})
    for name in ("tsp", "cluster", "overnight", "area_expansion", "fence", "dbscan", "road_network", "j_style"):
        plan = Planner(spark, c).run(points, name)
        rows = plan.days.filter("trip_type is null or trip_type = 'single_day'" if "trip_type" in plan.days.columns else "true").collect()
        assert all(r.drive_distance_km == 4.0 * (r.point_count - 1) for r in rows), name
        assert {r.nearest_km for r in plan.unassigned.collect()} <= {4.0, None}, name
    with pytest.raises(ValueError):
        Planner(spark, config.overridden(fixtures.CONFIG, {"distance.provider": "no such"})).run(points, "tsp")


def test_problems_are_not_laid_into_one_task(spark):
    """Points are few bytes and much work, so AQE, which goes by bytes, must not join their partitions."""
    points = spark.range(800).selectExpr("id % 40 as problem_id", "cast(id as int) as point_idx", "29.0D + id / 9000 as lat", "107.0D as lng")
    labels = growth.grouped(points, growth.chain_greedy(5))
    tasks = labels.select("problem_id", F.spark_partition_id().alias("task")).distinct()
    assert tasks.select("task").distinct().count() == 4 and tasks.count() == 40


def test_density_groups_make_no_pairs_of_dense_places(spark, monkeypatch):
    rng = np.random.default_rng(3)
    heaps = [(0, 106 + cx * 0.062 + rng.normal() * 0.008, 30 + cy * 0.055 + rng.normal() * 0.008) for cx in range(4) for cy in range(4) for _ in range(rng.integers(1, 30))]
    rows = [(p, k, "n", float(x), float(y)) for k, (p, x, y) in enumerate(heaps + [(1, 10 + k * 0.0359 * (1 + 0.0001 * (k % 3)), 0.0) for k in range(60)] + [(2, 10 + k % 4 * 0.04, 50.0) for k in range(30)])]
    points = spark.createDataFrame(rows, "problem_id long, point_idx int, name string, lng double, lat double").cache()
    want = sorted(map(tuple, density.groups(points, pairs.within(points, 4.0), 3).collect()))
    monkeypatch.setattr(density, "within", lambda *a: pytest.fail("all pairs in reach"))
    assert sorted(map(tuple, density.dbscan(points, 4.0, 3).collect())) == want
    assert len({(p, label) for p, _, label in want}) > 4


def detour(least=1.0):
    return Rule(lambda i, j: (i * 31 + j) % 9 != 0, lambda i, j, km: km * (least + (i + j) % 7 / 10.0), least=least)


def told(rule, pts):
    """The table that holds what the rule tells."""
    out = []
    for p, own in pts.groupby("problem_id"):
        idx, km = own["point_idx"].to_numpy(), tours.matrix(own["lat"].to_numpy(), own["lng"].to_numpy())
        out += [(p, i, j, float(np.round(rule.km(int(i), int(j), km[a, b]), 8))) for a, i in enumerate(idx) for b, j in enumerate(idx) if i < j and rule.knows(int(i), int(j))]
    return pd.DataFrame(out, columns=["problem_id", "i", "j", "km"]).astype({"problem_id": "int64", "i": "int32", "j": "int32", "km": "float64"})


@pytest.mark.parametrize("least", [1.0, 0.4])
def test_tours_by_a_rule_take_the_steps_of_its_table(least):
    """Ties, equal points and opposite places included."""
    rng, rule = random.Random(5), detour(least)
    far = pd.DataFrame([(0, k, "f", math.degrees(math.asin(rng.random() * 2 - 1)), rng.random() * 360 - 180) for k in range(60)], columns=["problem_id", "point_idx", "name", "lat", "lng"])
    grid = pd.DataFrame([(0, k, "g", 29.75 + rng.randrange(5) / 50, 107 + rng.randrange(5) / 50) for k in range(70)], columns=far.columns)
    for pts in (some_points(rng, 1), some_points(rng, 2), some_points(rng, 5), some_points(rng, 90), grid, far):
        pts = pts.assign(point_idx=pts["point_idx"] * 3 + 2)
        idx, e = pts["point_idx"].to_numpy(), told(rule, pts)
        places = pd.Index(idx)
        km = Distances(pts["lat"], pts["lng"], rule=rule, idx=idx)
        table = Distances(pts["lat"], pts["lng"], places.get_indexer(e["i"]), places.get_indexer(e["j"]), e["km"].to_numpy())
        m = table.matrix()
        assert (km.matrix() == m).all() and (km.part(0, len(pts) // 2).matrix() == m[: len(pts) // 2, : len(pts) // 2]).all() and not km.plain()
        first = tours.nearest_order(m)
        for own in (km, Distances(pts["lat"], pts["lng"])):
            m = own.matrix()
            assert tours.nearest_order(own) == (first := tours.nearest_order(m))
            for sweeps in (1, 1000):
                assert tours.two_opt(own, first, sweeps) == slow_two_opt(m, first, sweeps)


def test_two_opt_by_a_rule_works_out_few_distances(monkeypatch):
    """Of 600 stops, each row would be of 300 distances on average."""
    rng = random.Random(6)
    pts = some_points(rng, 600)
    km, asked, circle = Distances(pts["lat"], pts["lng"], rule=detour(), idx=pts["point_idx"].to_numpy()), [], Distances._circle
    monkeypatch.setattr(Distances, "_circle", lambda self, a, to: (asked.append(np.size(self.lat[to])), circle(self, a, to))[1])
    tours.two_opt(km, tours.nearest_order(km), 1000)
    assert np.mean(asked) < 60


@pytest.mark.parametrize("least", [0.4, 0.0])
def test_nearest_reach_and_legs_by_a_rule_are_those_of_its_table(spark, least):
    rng = random.Random(7)
    pts = some_points(rng, 40, 2)
    rule = detour(least) if least else Rule(lambda i, j: (i + j) % 2 == 0, lambda i, j, km: km * 0 + (i * j) % 50 / 2.0)
    e = told(rule, pts)
    points = spark.createDataFrame(pts, "problem_id long, point_idx int, name string, lat double, lng double")
    edges = spark.createDataFrame(e)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(pairs.nearest(points, rule)) == rows(pairs.nearest(points, edges))
    assert rows(pairs.reach(points, 6.0, rule)) == rows(pairs.reach(points, 6.0, edges).select("problem_id", "i", "j", "km"))
    stops = points.select("problem_id", (F.col("point_idx") % 3).alias("day"), (F.col("point_idx") % 7 * 100 + F.col("point_idx")).alias("stop_seq"), "point_idx")
    cols = ["problem_id", "day", "stop_seq", "point_idx", "leg_km"]
    assert rows(pairs.legs(stops, points, rule).select(cols)) == rows(pairs.legs(stops, points, edges).select(cols))


def test_plans_by_a_rule_are_those_of_its_table(spark):
    points = fixtures.many(spark, "/root/testdata/sf0.001")
    DISTANCES.register("rule_for_test")(lambda points, config: fixtures.ROAD_RULE)
    DISTANCES.register("table_for_test")(lambda points, config: fixtures.road_edges(spark, "/root/testdata/sf0.001").withColumnRenamed("road_km", "km"))
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for name, parts in (("tsp", ["stops", "metrics"]), ("overnight", ["stops", "metrics"]), ("dbscan", ["stops", "unassigned"])):
        by = {}
        for kind in ("table", "rule"):
            by[kind] = Planner(spark, config.overridden(fixtures.CONFIG, {"distance.provider": f"{kind}_for_test"})).run(points, name)
        assert isinstance(by["rule"].edges, Rule) and by["table"].edges.columns == ["problem_id", "i", "j", "km"]
        for part in parts:
            assert rows(getattr(by["rule"], part)) == rows(getattr(by["table"], part)), (name, part)
    config_of = config.overridden(fixtures.CONFIG, {"distance.provider": "fixture_road"})
    assert isinstance(Planner(spark, config_of).run(points, "tsp").edges, Rule)  # the road plans of the catalogue write no table of pairs


def test_pairs_of_one_problem_in_one_file_are_made_in_all_tasks(spark):
    rng = random.Random(8)
    pts = some_points(rng, 120, 2)
    points = spark.createDataFrame(pts[pts["problem_id"] > 0], "problem_id long, point_idx int, name string, lat double, lng double").coalesce(1)
    made = pairs.pairs(points)
    assert made.dtypes == [("problem_id", "bigint"), ("i", "int"), ("j", "int"), ("km", "double")]
    rows = made.withColumn("task", F.spark_partition_id()).collect()
    want = full(pts[pts["problem_id"] > 0], None)
    assert sorted((r.problem_id, r.i, r.j) for r in rows) == sorted(k for k in want if k[1] < k[2])
    assert all(abs(r.km - want[r.problem_id, r.i, r.j]) < 2e-6 for r in rows)
    assert len({r.task for r in rows}) == 4


def test_km_of_pairs_are_haversine_km_to_the_bit(spark):
    rng = random.Random(9)
    place = lambda: (math.degrees(math.asin(rng.random() * 2 - 1)), rng.random() * 360 - 180)
    rows = [(*place(), *place()) for _ in range(3000)] + [(29.8, 107.0, 29.8 + k * 1e-7, 107.0 + k * 1e-7) for k in range(2000)] + [(0.0, 0.0, 0.0, 180.0), (90.0, 5.0, -90.0, 5.0), (1.0, 1.0, 1.0, 1.0), (1.0, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "lat_i double, lng_i double, lat_j double, lng_j double").withColumns({f"cos_{t}": F.cos(F.radians(f"lat_{t}")) for t in "ij"})
    wrong = geo.pair_km(df, "i", "j").withColumn("want", geo.haversine_km(*(F.col(c) for c in ("lat_i", "lng_i", "lat_j", "lng_j"))))
    assert wrong.count() == len(rows) and wrong.filter("not km <=> want").count() == 0
    # halves, numbers next to them, and numbers beyond the sure ones
    x = [v for k in range(2000) for h in [(rng.randrange(10**9) + 0.5) / 1e6] for v in (h, float(np.nextafter(h, 0)), float(np.nextafter(h, 1e9)), rng.random() * 10 ** rng.randrange(-9, 15))]
    df = spark.createDataFrame([(v, v) for v in [*x, 0.0, float("inf"), None]], "x double, y double")
    assert geo.rounded(df, "x", 6).filter("not x <=> round(y, 6)").count() == 0 and geo.rounded(df, "x", 8).filter("not x <=> round(y, 8)").count() == 0


def test_road_pairs_by_a_rule_are_those_of_its_table(spark):
    rng = random.Random(10)
    pts = some_points(rng, 60)
    edges = pairs.pairs(spark.createDataFrame(pts, "problem_id long, point_idx int, name string, lat double, lng double"))
    table = spark.createDataFrame(told(detour(), pts)).withColumnRenamed("km", "road_km")
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(pairs.road_pairs(edges, detour()))
    assert got == rows(pairs.road_pairs(edges, table)) and {r[-1] for r in got} == {True, False}


def test_road_fallback_joins_no_table_of_pairs(spark):
    plan = catalogue.queries()["jn_road_fallback"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # of points and points


@pytest.mark.parametrize("most", [0.0, 0.00305, 700.0, 21000.0])
def test_near_pairs_are_those_of_haversine_km(spark, most):
    rng = random.Random(11)
    place = lambda: (math.degrees(math.asin(rng.random() * 2 - 1)), rng.random() * 360 - 180)
    rows = [(*place(), *place()) for _ in range(800)] + [(29.8, 107.0, 29.8 + k * 1e-7, 107.0 + k * 1e-7) for k in range(500)] + [(0.0, 0.0, 0.0, 180.0), (90.0, 5.0, -90.0, 5.0), (1.0, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "lat_i double, lng_i double, lat_j double, lng_j double").withColumns({f"cos_{t}": F.cos(F.radians(f"lat_{t}")) for t in "ij"})
    want = df.withColumn("km", geo.haversine_km(*(F.col(c) for c in ("lat_i", "lng_i", "lat_j", "lng_j")))).filter(F.col("km") <= most)
    assert sorted(map(tuple, geo.near_km(df, "i", "j", most).collect())) == sorted(map(tuple, want.collect())) != []
    plan = geo.near_km(df, "i", "j", most)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ASIN") == 1  # a filter would have it once for each time that it is named
