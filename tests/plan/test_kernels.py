"""Kernels against brute force and invariants, degenerate problems included."""

from itertools import combinations, permutations

import numpy as np
import pytest

from stopwise.operators import growth, tours

KERNELS = {
    "centroid": growth.centroid_greedy(5), "chain": growth.chain_greedy(4, (29.85, 107.08)), "isolation": growth.isolation_greedy(6), "greedy46": growth.greedy_between(4, 6),
    "capped": growth.capped_link(6), "voronoi": growth.voronoi(4, 6), "kmeans": growth.kmeans_capped(6), "separated": growth.kmeans_separated(3, 8), "grid": growth.grid_merged(5, 3, 9),
    "balanced": growth.voronoi_balanced(3, 2, 9), "chain_growth": growth.chain_growth(3), "region": growth.region_growth(3, 10.0), "area": growth.area_expansion(50, 3, 8), "circles": growth.compact_circles(3, 2, 12, rounds=5),
}


def problems():
    rng = np.random.default_rng(4)
    yield "none", np.zeros((0, 2))
    yield "one", np.array([[29.8, 107.0]])
    yield "two", np.array([[29.8, 107.0], [29.9, 107.1]])
    yield "same", np.repeat([[29.8, 107.0]], 5, 0)
    yield "line", np.column_stack([np.full(6, 29.8), 107 + np.arange(6) / 50])
    yield "lattice", np.array([[29.8 + i / 50, 107 + j / 50] for i in range(3) for j in range(3)])
    yield "random", np.column_stack([29.75 + rng.random(24) * 0.2, 106.7 + rng.random(24) * 0.8])


@pytest.mark.parametrize("name", KERNELS)
def test_groups_are_disjoint_and_within_range(name):
    for label, x in problems():
        if len(x):
            groups = KERNELS[name](x[:, 0], x[:, 1], tours.matrix(x[:, 0], x[:, 1]))
            members = sorted(i for g in groups for i in g)
            assert len(members) == len(set(members)), (name, label)
            assert name == "area" or members == list(range(len(x))), (name, label)


def test_caps_hold():
    for _, x in problems():
        if len(x):
            km = tours.matrix(x[:, 0], x[:, 1])
            for kernel, cap in ((growth.centroid_greedy(5), 5), (growth.chain_greedy(4), 4), (growth.isolation_greedy(6), 6), (growth.capped_link(6), 6), (growth.area_expansion(50, 3, 8), 8)):
                assert max((len(g) for g in kernel(x[:, 0], x[:, 1], km)), default=0) <= cap


def test_tours_visit_all_and_two_opt_never_lengthens():
    for _, x in problems():
        if len(x):
            km = tours.matrix(x[:, 0], x[:, 1])
            first = tours.nearest_order(km)
            better = tours.two_opt(km, first, 100)
            closed = lambda o, km=km: tours.open_length(km, [*o, o[0]])
            assert sorted(first) == sorted(better) == list(range(len(x))) and better[0] == 0
            assert closed(better) <= closed(first) + 1e-6
            if len(x) <= 6:
                assert tours.open_length(km, tours.best_open(km)) <= tours.open_length(km, first) + 1e-9
            if 2 < len(x) <= 5:
                assert tours.open_length(km, tours.best_open(km)) == pytest.approx(min(tours.open_length(km, list(o)) for o in permutations(range(len(x)))))


def test_enclosing_circle_against_all_pairs_and_triples():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 7, 15):
        x = rng.random((n, 2))
        a, b, r = growth.enclosing_circle(x)
        assert np.hypot(x[:, 0] - a, x[:, 1] - b).max() <= r + 1e-9
        best = 0.0 if n == 1 else np.inf
        for c in [(p + q) / 2 for p, q in combinations(x, 2)] + [growth.enclosing_circle(np.array(t))[:2] for t in combinations(x, 3)]:
            best = min(best, np.hypot(*(x - np.array(c)).T).max())
        assert r == pytest.approx(best, abs=1e-9)


def test_hull_of_lattice():
    x = np.array([[i, j] for i in range(3) for j in range(3)], float)
    assert len(growth.hull(x)) == 4 and growth.hull_area(x) == pytest.approx(4.0)
    assert growth.hull_area(x[:3]) == 4.0 or growth.hull_area(x[:3]) == 0.0


def test_first_centres_of_many_points_are_the_plain_ones():
    rng = np.random.default_rng(3)
    spread = np.column_stack([29.75 + rng.random(3000) * 0.2, 106.7 + rng.random(3000) * 0.8])
    for x, k in ((spread, 500), (np.repeat(spread[:300], 5, axis=0), 400), (spread[:97], 97), (np.repeat(spread[:2], 40, axis=0), 60), (np.round(spread, 2), 300)):
        for seed in range(3):
            one, two = np.random.default_rng(seed), np.random.default_rng(seed)
            many = growth._Chances(x)
            for _ in range(2):
                assert (many.centres(k, one) == growth._first_centres(x, k, two)).all()
            assert one.random() == two.random()


def test_first_centres_do_not_look_at_all_points(monkeypatch):
    x = np.random.default_rng(5).random((6000, 2))
    monkeypatch.setattr(growth, "_first_centres", lambda *_: pytest.fail("all points for each centre"))
    assert len(np.unique(growth.lloyd(x, 1000, restarts=1, rounds=1))) > 900


def test_best_open_is_the_first_least_of_all_orders():
    rng = np.random.default_rng(8)
    for n in (3, 4, 5):
        for k in range(40):
            x = np.column_stack([29.8 + rng.integers(0, 3, n) / 50, 107 + rng.integers(0, 3, n) / 50])  # many ties
            km = tours.Distances(x[:, 0], x[:, 1])
            want = min(permutations(range(n)), key=lambda o: round(tours.open_length(km.matrix(), list(o)), 6))
            assert tours.best_open(km) == list(want), (n, k)


def test_part_of_distances_with_known_pairs():
    rng = np.random.default_rng(2)
    x = rng.random((9, 2))
    i, j = (np.array(v) for v in zip(*[(a, b) for a, b in combinations(range(9), 2) if (a + 2 * b) % 3], strict=True))
    km = tours.Distances(x[:, 0], x[:, 1], i, j, rng.random(len(i)))
    for low, high in ((0, 9), (0, 4), (3, 4), (4, 9)):
        own = km.part(low, high)
        assert len(own) == high - low and (own.matrix() == km.matrix()[low:high, low:high]).all()


def plain_area(threshold, least, most):
    """Area growth that asks every free point for the area of its hull."""

    def run(lat, lng, km):
        x, free, tried, out = growth.plane(lat, lng), set(range(len(lat))), set(), []
        while seeds := free - tried:
            g, now = [min(seeds, key=lambda i: (lng[i], i))], 0.0
            tried.add(g[0])
            while len(g) < most and free - set(g):
                area, i = min((growth.hull_area(x[[*g, i]]), i) for i in free - set(g))
                if area - now > threshold:
                    break
                g.append(i)
                now = area
            if len(g) >= least:
                free -= set(g)
                out.append(g)
        return out

    return run


def many_places():
    rng = np.random.default_rng(6)
    spread = np.column_stack([29.75 + rng.random(90) * 0.2, 106.7 + rng.random(90) * 0.8])
    yield from (spread, np.repeat(spread[:30], 3, 0)[rng.permutation(90)], np.column_stack([29.75 + rng.integers(0, 9, 90) / 50, 106.7 + rng.integers(0, 9, 90) / 50]))
    yield from (np.column_stack([np.full(90, 29.8), 107 + rng.permutation(90) / 50]), np.column_stack([np.degrees(np.arcsin(rng.random(90) * 2 - 1)), rng.random(90) * 360 - 180]))


def test_area_growth_is_that_of_asking_all_points():
    for x in many_places():
        for options in ((50.0, 3, 6), (0.01, 4, 5), (1e-6, 3, 4)):
            assert growth.area_expansion(*options)(x[:, 0], x[:, 1], None) == plain_area(*options)(x[:, 0], x[:, 1], None), options


def test_area_growth_does_not_look_at_all_points(monkeypatch):
    x = np.column_stack([29.75 + (rng := np.random.default_rng(7)).random(9000) * 0.2, 106.7 + rng.random(9000) * 0.8])
    looked, may_be_least = [], getattr(growth, "_may_be_least", lambda h, places, slack: range(len(x)))

    def counted(*args):
        looked.append(len(found := may_be_least(*args)))
        return found

    monkeypatch.setattr(growth, "_may_be_least", counted, raising=False)
    groups = growth.area_expansion(300.0, 2, 6)(x[:, 0], x[:, 1], None)
    assert sum(map(len, groups)) == 9000 and looked and np.mean(looked) < 1000


def plain_centroid(most):
    """Centroid growth that works out the distance of every point that is left."""

    def run(lat, lng, km):
        at, left, out = tours.Distances(lat, lng), list(range(len(lat))), []
        while left:
            g = [left[int(at.to(lat[left].mean(), lng[left].mean(), np.array(left)).argmax())]]
            left.remove(g[0])
            while len(g) < most and left:
                g.append(left[int(at.to(lat[g].mean(), lng[g].mean(), np.array(left)).argmin())])
                left.remove(g[-1])
            out.append(g)
        return out

    return run


def test_centroid_growth_is_that_of_asking_all_points():
    for x in many_places():
        for most in (1, 5, 30):
            assert growth.centroid_greedy(most)(x[:, 0], x[:, 1], None) == plain_centroid(most)(x[:, 0], x[:, 1], None), most


def test_centroid_growth_does_not_work_out_all_distances(monkeypatch):
    x = np.column_stack([29.75 + (rng := np.random.default_rng(7)).random(4000) * 0.2, 106.7 + rng.random(4000) * 0.8])
    asked, to = [], tours.Distances.to
    monkeypatch.setattr(tours.Distances, "to", lambda self, lat, lng, to_=slice(None): (asked.append(len(self.lat[to_])), to(self, lat, lng, to_))[1])
    groups = growth.centroid_greedy(5)(x[:, 0], x[:, 1], None)
    assert len(groups) == 800 and sum(asked) < 4000


def test_points_without_a_place_are_grouped_too():
    x = np.column_stack([29.75 + np.arange(12) / 50, 107 + np.arange(12) / 50])
    x[[3, 7]] = np.nan
    with np.errstate(invalid="ignore"):
        assert sorted(i for g in growth.centroid_greedy(5)(x[:, 0], x[:, 1], None) for i in g) == list(range(12))
