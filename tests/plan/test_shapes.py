"""Hulls that merge, diameters and gaps of groups, and the containment index, against brute force."""

import random

import numpy as np
import pytest

from stopwise.operators import growth, match, metrics, shapes, tours
from stopwise.plans import exports

SCHEMA = "problem_id long, point_idx int, name string, lat double, lng double, label int"


def clouds():
    rng = np.random.default_rng(6)
    disc = rng.normal(size=(80, 2))
    yield "near", np.column_stack([29.7 + rng.random(70) / 5, 106.8 + rng.random(70)])
    yield "ring", np.column_stack([50 + np.sin(np.arange(60)) / 9, 8 + np.cos(np.arange(60)) / 9])
    yield "wide", np.column_stack([rng.random(50) * 170 - 85, rng.random(50) * 360 - 180])
    yield "pole", np.column_stack([85 + rng.random(40) * 5, rng.random(40) * 360 - 180])
    yield "line", np.column_stack([np.full(30, 10.0), 20 + np.arange(30) / 8])
    yield "same", np.repeat([[3.0, 4.0]], 9, 0)
    yield "one", np.array([[1.0, 2.0]])
    yield "two", np.array([[1.0, 2.0], [1.5, 2.5]])
    yield "date line", np.column_stack([disc[:, 0], np.where(disc[:, 1] > 0, disc[:, 1] - 180, disc[:, 1] + 180)])
    yield "lattice", np.array([[i / 10, j / 10] for i in range(7) for j in range(7)])


def rows_of():
    rows, k = [], 0
    for label, (_, x) in enumerate(clouds()):
        for lat, lng in x.tolist():
            rows.append((1, k, f"p{k}", lat, lng, label))
            k += 1
    random.Random(1).shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(5)
    yield df.drop("label"), df.select("problem_id", "point_idx", "label")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_diameters_equal_all_pairs(labelled):
    got = {r.label: r.max_km for r in metrics.spread(*labelled).collect()}
    for label, (name, x) in enumerate(clouds()):
        assert got[label] == pytest.approx(tours.matrix(x[:, 0], x[:, 1]).max(), abs=2e-6), name


def test_hulls_and_circles_merge(labelled):
    hulls = {r.label: r for r in shapes.hulls(*labelled).collect()}
    circles = {r.label: r for r in shapes.circle_of_groups(*labelled).collect()}
    for label, (name, x) in enumerate(clouds()):
        whole = growth.hull(x[:, ::-1])
        assert sorted((c.lng, c.lat) for c in hulls[label].corners) == sorted(map(tuple, whole.tolist())), name
        if len(whole) > 2:
            assert hulls[label].area_km2 == pytest.approx(growth.hull_area(whole) * 111 * 111 * np.cos(np.radians(x[:, 0].mean())), rel=1e-6), name
        assert circles[label].r == pytest.approx(growth.enclosing_circle(x)[2], abs=1e-8), name


def test_corners_are_few(labelled):
    assert shapes.corners(*labelled).filter("label = 0").count() < 50


def test_gaps_equal_all_pairs(labelled):
    got = {(r.label_a, r.label_b): r.min_km for r in metrics.gaps(*labelled).collect()}
    found = list(clouds())
    for a in range(len(found)):
        for b in range(a + 1, len(found)):
            x, y = found[a][1], found[b][1]
            km = tours.matrix(np.append(x[:, 0], y[:, 0]), np.append(x[:, 1], y[:, 1]))[: len(x), len(x) :].min()
            assert got[a, b] == pytest.approx(km, abs=2e-6), (found[a][0], found[b][0])
    assert len(got) == len(found) * (len(found) - 1) // 2


def test_calipers_find_the_widest_pair_of_a_polygon():
    rng = np.random.default_rng(2)
    for n in (2, 3, 5, 30):
        h = growth.hull(rng.random((n, 2)))
        far = max(np.hypot(*(h[a] - h[b])) for a, b in shapes.antipodal(h))
        assert far == pytest.approx(max(np.hypot(*(p - q)) for p in h for q in h))


def test_containment_index_equals_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab小·") for _ in range(rng.randint(0, 6)))
    xs, ys = [word() for _ in range(60)] + [None, "zzz"], [word() + word() for _ in range(60)] + [None, ""]
    got = match.containing(spark.createDataFrame([(x,) for x in xs], "x string"), spark.createDataFrame([(y,) for y in ys], "y string"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(x, y) for x in xs for y in ys if x and y and x in y}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50 and got.count() == len(want)


def test_fuzzy_plan_has_no_nested_loop(spark):
    points = spark.createDataFrame([(1, "Zone.a-b"), (2, "Zone.q")], "row_id int, name string")
    survey = spark.createDataFrame([("xab", 2, {"k": "v"}), ("ab", 1, {"k": "w"})], "key string, seq int, attrs map<string,string>")
    found = match.fuzzy(points, survey, "Zone.")
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.row_id, r.attrs) for r in found.collect()] == [(1, {"k": "w"})]


def test_regions_go_by_the_number_of_stops(spark):
    """Stops in a line or at one place have fewer corners than stops."""
    at = {1: [(29.8, 107.0), (29.8, 107.1), (29.8, 107.05)], 2: [(29.8, 107.0)] * 3, 3: [(29.9, 107.0)] * 2, 4: [(29.7, 107.0)]}
    rows = [(0, 10 * day + k, day, k, lat, lng) for day, own in at.items() for k, (lat, lng) in enumerate(own)]
    df = spark.createDataFrame(rows, "problem_id long, point_idx int, day int, stop_seq int, lat double, lng double")
    got = {r["day"]: (r["kind"], [(c["lat"], c["lng"]) for c in r["corners"]]) for r in exports.region_shapes(df, df.select("problem_id", "day", "stop_seq", "point_idx")).collect()}
    assert got[1] == ("hull", [(29.8, 107.0), (29.8, 107.1)]) and got[2] == ("hull", [(29.8, 107.0)])
    assert [got[d][0] for d in (3, 4)] == ["circle"] * 2
    assert [max(lat for lat, _ in got[d][1]) - at[d][0][0] for d in (3, 4)] == pytest.approx([0.002, 0.3 / 111.0])


def test_parts_of_texts_are_not_broadcast(spark):
    """Spark reckons exploded parts as small as their table; names that begin alike do not meet."""
    x = spark.range(50).selectExpr("format_string('Name#%09d', id) as x")
    y = spark.range(50).selectExpr("format_string('at Name#%09d, left', id) as y")
    got = match.containing(x, y)
    assert got.count() == 50
    met = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in met and "contains(" not in met.lower()
