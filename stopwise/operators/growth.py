"""Groupings that grow or repair groups step by step, one problem per group of a grouped map.

Every kernel takes the points of one problem in index order (``lat``, ``lng`` and distances in km, of which it reads a row at a
time) and returns lists of positions, a list per group in the order in which its members came. :func:`grouped` runs a kernel over all problems and
gives ``problem_id, point_idx, label, seq``; points that a kernel leaves out get label -1.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .distances import Distances, Rule, per_problem
from .places import Places
from .tours import Km

Groups = list[list[int]]
Kernel = Callable[[np.ndarray, np.ndarray, Km], Groups]
LABELS = "problem_id long, point_idx int, label int, seq int"


def grouped(points: DataFrame, kernel: Kernel, edges: DataFrame | Rule | None = None) -> DataFrame:
    """``edges``, a provider's sparse table or rule, replaces the great-circle distances of its pairs."""

    def run(p: pd.DataFrame, km: Distances) -> pd.DataFrame:
        lat, lng = p["lat"].to_numpy(float), p["lng"].to_numpy(float)
        label, seq = np.full(len(p), -1), np.zeros(len(p), int)
        for k, members in enumerate(g for g in kernel(lat, lng, km) if g):
            label[members], seq[members] = k, range(len(members))
        return pd.DataFrame({"problem_id": p["problem_id"], "point_idx": p["point_idx"], "label": label, "seq": seq})

    return per_problem(points.select("problem_id", "point_idx", "lat", "lng"), edges, ["problem_id"], run, LABELS)


def _pick(values: np.ndarray, allowed: np.ndarray, most: bool = False) -> int:
    """The best allowed position; ties go to the lowest."""
    v = np.where(allowed, values, -np.inf if most else np.inf)
    return int(v.argmax() if most else v.argmin())


def centroid_greedy(most: int) -> Kernel:
    """Seeds farthest from the mean of what is left; each group takes the point nearest to its own mean.

    Distances are worked out of the points that straight lines through the earth do not rule out. The mean of what is left comes
    from whole numbers, so it is the same in whatever order points went.
    """

    def run(lat, lng, km):
        at, out = Distances(lat, lng), []
        places = Places(lat, lng, at.vectors().T)
        whole = [[int(v * _ONE) if math.isfinite(v) else 0 for v in c.tolist()] for c in (lat, lng)]  # a power of two loses no digits
        sums = [sum(c) for c in whole]

        def take(i: int) -> int:
            places.take(i)
            for c in (0, 1):
                sums[c] -= whole[c][i]
            return i

        while n := places.left * _ONE:
            g = [take(_from_mean(places, at, sums[0] / n, sums[1] / n, True))]
            while len(g) < most and places.left:
                g.append(take(_from_mean(places, at, lat[g].mean(), lng[g].mean(), False)))
            out.append(g)
        return out

    return run


#: What coordinates are multiplied by to be whole.
_ONE = 1 << 100
#: What rounding of distances and of chords of a globe of radius 1 may come to, and a squared chord from which it may be more.
_CHORD, _OPPOSITE = 1e-9, 3.9


def _from_mean(places: Places, at: Distances, lat: float, lng: float, most: bool) -> int:
    """The point that is left farthest from (nearest to) a place; ties go to the lowest."""
    a, b = math.radians(lat), math.radians(lng)
    q = np.array([[math.cos(a) * math.cos(b)], [math.cos(a) * math.sin(b)], [math.sin(a)]])
    if most:
        bounds, value = -places.across(q), lambda x: -((x - q) ** 2).sum(0)
        within = lambda v: -(max(0.0, min(-v, _OPPOSITE) ** 0.5 - _CHORD) ** 2)
    else:
        bounds, value = places.outside(q), lambda x: ((x - q) ** 2).sum(0)
        within = lambda v: (v**0.5 + _CHORD) ** 2 if v < _OPPOSITE else np.inf
    found = places.search(bounds, value, within)
    chord = value(places.x[:, found])
    found = np.sort(places.lowest[found[~(chord > within(chord.min()))]])
    if len(found) == 1:
        return int(found[0])
    away = at.to(lat, lng, found)
    return int(found[away.argmax() if most else away.argmin()])


def chain_greedy(most: int, base: tuple[float, float] | None = None, farthest: bool = False) -> Kernel:
    """Seeds nearest to the base (farthest, for trips with a night away); each group takes the point nearest to its last."""

    def run(lat, lng, km):
        from_base = Distances(lat, lng).to(*base) if base else np.zeros(len(lat))
        left, out = np.ones(len(lat), bool), []
        while left.any():
            g = [_pick(from_base, left, farthest)]
            left[g] = False
            while len(g) < most and left.any():
                g.append(_pick(km[g[-1]], left))
                left[g] = False
            out.append(g)
        return out

    return run


def isolation_greedy(most: int, least: int = 1) -> Kernel:
    """Seeds with the largest mean distance to what is left; groups grow by the nearest point to any member.

    With ``least``, a tail shorter than that joins the nearest groups that have room, or forms the last group.
    """

    def run(lat, lng, km):
        left, out = np.ones(len(lat), bool), []
        whole = lambda row: np.rint(row * 1e9).astype(np.int64)  # noqa: E731  sums of distances that are exact in any order
        total = np.array([whole(km[a]).sum() for a in range(len(lat))], np.int64)
        while left.any():
            n = int(left.sum())
            if out and n < least:
                for i in np.flatnonzero(left):
                    room, row = [g for g in out if len(g) < most], km[i]
                    if room:
                        min(room, key=lambda g: row[g].min()).append(int(i))
                        left[i] = False
                out += [[int(i) for i in np.flatnonzero(left)]] if left.any() else []
                break
            size = min(most, n)
            if 0 < n - size < least <= size - (least - (n - size)):
                size -= int(least - (n - size))
            g, near = [], None
            while len(g) < size:
                i = int(np.where(left, total, -1).argmax()) if near is None else _pick(near, left)
                row = km[i]
                near = row if near is None else np.minimum(near, row)
                g.append(i)
                left[i] = False
                total -= whole(row)
            out.append(g)
        return out

    return run


def capped_link(most: int, link_km: float = 5.0) -> Kernel:
    """Single-link merging by ascending distance, while a merged group keeps within ``most`` and ``link_km``."""

    def run(lat, lng, km):
        rows = [(a + 1 + np.flatnonzero((row := km[a][a + 1 :]) <= link_km), row[row <= link_km]) for a in range(len(lat))]
        i = np.repeat(np.arange(len(lat)), [len(own) for own, _ in rows])
        j, away = (np.concatenate([r[k] for r in rows]) if rows else np.empty(0, int) for k in (0, 1))
        order = np.lexsort((j, i, away))
        owner, members = list(range(len(lat))), {k: [k] for k in range(len(lat))}
        for a, b in zip(i[order], j[order], strict=True):
            x, y = sorted((owner[a], owner[b]))
            if x != y and len(members[x]) + len(members[y]) <= most:
                for k in members[y]:
                    owner[k] = x
                members[x] += members.pop(y)
        return [sorted(g) for _, g in sorted(members.items())]

    return run


def farthest_seeds(lat: np.ndarray, lng: np.ndarray, km: Km, k: int) -> list[int]:
    """The point nearest to the mean, then always the one farthest from all seeds."""
    free = np.ones(len(lat), bool)
    seeds = [_pick(Distances(lat, lng).to(lat.mean(), lng.mean()), free)]
    near = km[seeds[0]]
    while len(seeds) < min(k, len(lat)):
        free[seeds[-1]] = False
        seeds.append(_pick(near, free, True))
        near = np.minimum(near, km[seeds[-1]])
    return seeds


def seeded(k: int) -> Kernel:
    """The farthest-point seeds alone, a group each."""
    return lambda lat, lng, km: [[s] for s in farthest_seeds(lat, lng, km, k)]


def nearest_centres(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The position in ``c`` of the nearest to each of ``x``; ties go to the lowest.

    Centres are looked up in the nine grid cells around a point; a point without one closer than a cell is wide is looked at
    again with cells of twice the width, in the end with all centres.
    """
    near, rest, k = np.empty(len(x), int), np.arange(len(x)), len(c)
    low = np.minimum(x.min(0), c.min(0))
    extent = np.maximum(x.max(0), c.max(0)) - low
    step = max(np.sqrt(2 * extent.prod() / k), extent.max() * 2 / k)
    while len(rest):
        if k <= 32 or not step > 0 or (cells := (extent // step).astype(int) + 1).prod() <= 16:
            for part in np.array_split(rest, -(-len(rest) * k // (1 << 20))):
                near[part] = ((x[part][:, None] - c) ** 2).sum(-1).argmin(1)
            break
        wide = cells[0] + 2
        place = lambda p: (np.minimum((p - low) // step, cells - 1).astype(int) + 1) @ np.array([1, wide])
        own = place(c)
        order, start = np.argsort(own, kind="stable"), np.append(0, np.cumsum(np.bincount(own, minlength=wide * (cells[1] + 2))))
        unsure = []
        for part in np.array_split(rest, -(-len(rest) // 20_000)):
            rows = place(x[part])[:, None] + np.array([-wide, 0, wide])
            first, last = start[rows - 1].ravel(), start[rows + 2].ravel()
            size = last - first
            at = np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            found, many = order[at], size.reshape(-1, 3).sum(1)
            d = ((np.repeat(x[part], many, axis=0) - c[found]) ** 2).sum(-1)
            met = many > 0
            begin = (np.append(0, np.cumsum(many)[:-1]))[met]
            best, which = np.full(len(part), np.inf), np.full(len(part), k)
            if met.any():
                best[met] = np.minimum.reduceat(d, begin)
                which[met] = np.minimum.reduceat(np.where(d == np.repeat(best, many), found, k), begin)
            sure = best < (step * (1 - 1e-9)) ** 2
            near[part[sure]] = which[sure]
            unsure.append(part[~sure])
        rest, step = np.concatenate(unsure), step * 2
    return near


def _first_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: the first centre at random, the next with chances by squared distance to the nearest so far."""
    c, d = np.empty((k, 2)), np.full(len(x), np.inf)
    for m in range(k):
        c[m] = x[rng.integers(len(x)) if m == 0 else rng.choice(len(x), p=d / total) if (total := d.sum()) > 0 else m]
        d = np.minimum(d, ((x - c[m]) ** 2).sum(-1))
    return c


#: Points to a block of :class:`_Chances`, and points times centres from which it is used.
_BLOCK, _MANY = 32, 1 << 16


class _Chances:
    """:func:`_first_centres` of many points, the same to the bit, without all points for each centre.

    A new centre is held against blocks of neighbouring points, and only those are looked at that reach nearer to it than their
    farthest point is to its own centre. A draw goes by sums of blocks in index order; where rounding might
    turn it, it is made from all points.
    """

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        blocks = -(-n // _BLOCK)
        strip = (np.argsort(np.argsort(x[:, 0], kind="stable")) // (_BLOCK * max(1, int(np.sqrt(blocks))))).astype(int)
        near = np.lexsort((x[:, 1], strip))
        self.near = np.append(near, np.full(blocks * _BLOCK - n, near[-1])).reshape(blocks, _BLOCK)
        self.low, self.high = x[self.near].min(1), x[self.near].max(1)
        self.sure = 8 * (n + _BLOCK) * np.finfo(float).eps

    def _drawn(self, d: np.ndarray, sums: np.ndarray, u: float) -> int:
        ends = np.cumsum(sums)
        at = u * ends[-1]
        b = min(int(np.searchsorted(ends, at, side="right")), len(ends) - 1)
        inside = np.cumsum(d[b * _BLOCK : (b + 1) * _BLOCK]) + (ends[b - 1] if b else 0.0)
        k = int(np.searchsorted(inside, at, side="right"))
        slack = self.sure * ends[-1]
        if k < len(inside) and inside[k] - at > slack and (at - (inside[k - 1] if k else ends[b - 1] if b else -slack) > slack or b == k == 0):
            return b * _BLOCK + k
        whole = d[: len(self.x)]
        sure = (whole / whole.sum()).cumsum()  # as Generator.choice does
        return int((sure / sure[-1]).searchsorted(u, side="right"))

    def centres(self, k: int, rng: np.random.Generator) -> np.ndarray:
        x, near = self.x, self.near
        c, d = np.empty((k, 2)), np.zeros(near.size)
        d[: len(x)] = np.inf
        far, sums = np.full(len(near), np.inf), np.zeros(len(near))
        for m in range(k):
            c[m] = x[rng.integers(len(x)) if m == 0 else self._drawn(d, sums, rng.random()) if sums.any() else m]
            out = np.maximum(np.maximum(self.low - c[m], c[m] - self.high), 0.0)
            some = np.flatnonzero((out**2).sum(-1) < far)
            own = near[some]
            then = np.minimum(d[own], ((x[own] - c[m]) ** 2).sum(-1))
            changed = np.unique(own[then < d[own]] // _BLOCK) if m else slice(None)
            d[own], far[some] = then, then.max(1)
            sums[changed] = d.reshape(-1, _BLOCK)[changed].sum(1)
        return c


def lloyd(x: np.ndarray, k: int, seed: int = 0, restarts: int = 10, rounds: int = 100) -> np.ndarray:
    """Seeded k-means++ with restarts; labels in order of first appearance."""
    best, rng = None, np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    many = _Chances(x) if len(x) * k >= _MANY else None
    for _ in range(restarts):
        c = many.centres(k, rng) if many else _first_centres(x, k, rng)
        for _ in range(rounds):
            near = nearest_centres(x, c)
            size = np.bincount(near, minlength=k)[:, None]
            sums = np.column_stack([np.bincount(near, weights=x[:, a], minlength=k) for a in (0, 1)])
            new = np.where(size > 0, sums / np.maximum(size, 1), c)
            if (np.abs(new - c) <= 1e-8 + 1e-5 * np.abs(c)).all():
                break
            c = new
        cost = ((x - c[near]) ** 2).sum()
        if best is None or cost < best[0] - 1e-12:
            best = (cost, near)
    return pd.factorize(best[1])[0]


def _as_groups(label: np.ndarray) -> Groups:
    return [g.tolist() for g in np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label))[:-1])] if len(label) else []


def split_large(groups: Groups, lat: np.ndarray, lng: np.ndarray, most: int) -> Groups:
    """Groups over ``most`` cut by k-means into as many parts as they need, and their parts again until all keep within it.

    Equal points, which k-means can't part, are dealt in index order.
    """
    out, waiting = [], list(reversed(groups))
    while waiting:
        g = waiting.pop()
        if len(g) <= most:
            out.append(g)
            continue
        own = np.array(g)
        parts = _as_groups(lloyd(np.column_stack([lat, lng])[own], -(-len(g) // most)))
        waiting += [own[part].tolist() for part in reversed(parts)] if len(parts) > 1 else [g[lo : lo + most] for lo in reversed(range(0, len(g), most))]
    return out


def _by_seed(lat: np.ndarray, lng: np.ndarray, km: Km, k: int) -> Groups:
    """Each point with the nearest of ``k`` farthest-point seeds."""
    return _as_groups(pd.factorize(np.array([km[s] for s in farthest_seeds(lat, lng, km, k)]).argmin(0))[0])


def voronoi(k: int = 6, most: int = 15) -> Kernel:
    return lambda lat, lng, km: split_large(_by_seed(lat, lng, km, k), lat, lng, most)


def kmeans_capped(most: int) -> Kernel:
    """K-means with as many groups as needed, then a split."""
    return lambda lat, lng, km: split_large(_as_groups(lloyd(np.column_stack([lat, lng]), -(-len(lat) // most))), lat, lng, most)


def kmeans_separated(k: int, most: int, seeds: int = 10) -> Kernel:
    """Of several seeded k-means the one with the best ratio of least centre gap to largest radius, then a split."""

    def run(lat, lng, km):
        x = np.column_stack([lat, lng])

        def ratio(label: np.ndarray) -> float:
            c = np.array([x[label == g].mean(0) for g in range(label.max() + 1)])
            r = max(np.sqrt(((x[label == g] - c[g]) ** 2).sum(1)).max() for g in range(len(c)))
            gap = min((np.hypot(*(a - b)) for i, a in enumerate(c) for b in c[:i]), default=0.0)
            return gap / r if r > 0 else np.inf

        tries = [lloyd(x, k, seed=s, restarts=1) for s in range(seeds)]
        return split_large(_as_groups(max(tries, key=ratio)), lat, lng, most)

    return run


def grid_merged(cell_km: float, target: int, most: int) -> Kernel:
    """Grid cells, the two nearest merged until ``target`` are left, then a split."""

    def run(lat, lng, km):
        cells = np.column_stack([(lat - lat.min()) // (cell_km / 111.0), (lng - lng.min()) // (cell_km / (111.0 * np.cos(np.radians(lat.mean()))))])
        groups = _as_groups(np.unique(cells, axis=0, return_inverse=True)[1].ravel())
        order, start = np.concatenate(groups), np.cumsum([0] + [len(g) for g in groups[:-1]])
        gaps = np.array([np.minimum.reduce([np.minimum.reduceat(km[i][order], start) for i in g]) for g in groups])
        gaps[np.tri(len(gaps), dtype=bool)] = np.inf
        while len(groups) > max(1, target):
            a, b = (int(v) for v in np.unravel_index(gaps.argmin(), gaps.shape))
            groups[a] += groups.pop(b)
            both = np.minimum(np.minimum(gaps, gaps.T)[a], np.minimum(gaps, gaps.T)[b])
            gaps[a, a + 1 :], gaps[:a, a] = both[a + 1 :], both[:a]
            gaps = np.delete(np.delete(gaps, b, 0), b, 1)
        return split_large([sorted(g) for g in groups], lat, lng, most)

    return run


def balanced(groups: Groups, km: Km, least: int, most: int, rounds: int = 100) -> Groups:
    """Moves single points from groups over ``most`` to near ones with room, then into groups under ``least`` from near ones
    that can spare them."""
    groups = [list(g) for g in groups if g]
    rows: dict[int, np.ndarray] = {}  # by group: the distance of each point to its nearest member

    def nearest(k: int) -> np.ndarray:
        if k not in rows:
            rows[k] = np.full(len(km), np.inf)
            for i in groups[k]:
                np.minimum(rows[k], km[i], out=rows[k])
        return rows[k]

    def move(i: int, a: int, b: int) -> None:
        groups[a].remove(i)
        groups[b].append(i)
        rows.pop(a, None)
        rows[b] = np.minimum(nearest(b), km[i])

    every = range(len(groups))
    for _ in range(rounds):
        big = next((k for k in every if len(groups[k]) > most), None)
        room = [k for k in every if len(groups[k]) < most]
        if big is not None and room:
            own = np.sort(groups[big])
            away = np.array([nearest(k)[own] for k in room])
            at = int(away.min(0).argmin())
            move(int(own[at]), big, room[int(away[:, at].argmin())])
            continue
        thin = next((k for k in every if len(groups[k]) < least), None)
        rich = [k for k in every if len(groups[k]) > least]
        if thin is None or not rich:
            break
        own = np.concatenate([groups[k] for k in rich])
        owner = np.repeat(rich, [len(groups[k]) for k in rich])[np.argsort(own)]
        own = np.sort(own)
        at = int(nearest(thin)[own].argmin())
        move(int(own[at]), int(owner[at]), thin)
    return groups


def voronoi_balanced(k: int, least: int, most: int) -> Kernel:
    return lambda lat, lng, km: balanced(_by_seed(lat, lng, km, k), km, least, most)


def _grown(km: Km, seeds: list[int], cap: int, mean: bool, radius: float) -> tuple[Groups, np.ndarray, list[np.ndarray]]:
    """Groups grown side by side, the smallest first, by the free point nearest to any member, or of least ``mean`` distance,
    within ``radius``; also what is free, and each group's least distances (sums of distances) to all points."""
    groups, free, stuck = [[s] for s in seeds], np.ones(len(km), bool), set()
    reach = [km[s] for s in seeds]
    free[seeds] = False
    while free.any() and len(stuck) < len(groups):
        k = min((k for k in range(len(groups)) if k not in stuck), key=lambda k: (len(groups[k]), k))
        far = reach[k] / len(groups[k]) if mean else reach[k]
        i = _pick(far, free)
        if len(groups[k]) >= cap or far[i] > radius:
            stuck.add(k)
            continue
        groups[k].append(i)
        reach[k] = reach[k] + km[i] if mean else np.minimum(reach[k], km[i])
        free[i] = False
    return groups, free, reach


def chain_growth(k: int) -> Kernel:
    """Groups grow from farthest-point seeds by the point nearest to any member, up to n // k + 2; leftovers go to the nearest."""

    def run(lat, lng, km):
        groups, free, reach = _grown(km, farthest_seeds(lat, lng, km, k), len(lat) // max(1, k) + 2, False, np.inf)
        for i in np.flatnonzero(free):
            own = min(range(len(groups)), key=lambda g: reach[g][i])
            groups[own].append(int(i))
            reach[own] = np.minimum(reach[own], km[i])
        return groups

    return run


def region_growth(k: int, radius_km: float, least: int = 3) -> Kernel:
    """Groups grow by the point of least mean distance within a radius; leftovers go to the nearest by mean, small groups merge."""

    def run(lat, lng, km):
        groups, free, _ = _grown(km, farthest_seeds(lat, lng, km, k), len(lat), True, radius_km)
        for i in np.flatnonzero(free):
            row = km[i]
            min(groups, key=lambda g: (row[g].mean(), len(g))).append(int(i))
        return merged_small(groups, km, least, len(lat))

    return run


def merged_small(groups: Groups, km: Km, least: int, most: int) -> Groups:
    """Groups under ``least`` joined to the nearest that stays within ``most``."""
    groups = [list(g) for g in groups if g]
    for g in sorted((g for g in groups if len(g) < least), key=len):
        others = [o for o in groups if o is not g and len(o) + len(g) <= most]
        if others and any(o is g for o in groups):
            near = np.minimum.reduce([km[i] for i in g])
            min(others, key=lambda o: near[o].min()).extend(g)
            groups = [o for o in groups if o is not g]
    return groups


def greedy_between(least: int = 4, most: int = 6) -> Kernel:
    """Isolation growth with a tail rule, small groups merged, large ones split."""

    def run(lat, lng, km):
        return split_large(merged_small(isolation_greedy(most, least)(lat, lng, km), km, least, most), lat, lng, most)

    return run


def plane(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Local km coordinates."""
    return np.column_stack([(lng - lng.mean()) * 111.0 * np.cos(np.radians(lat.mean())), (lat - lat.mean()) * 111.0])


def on_hull(x: np.ndarray, slack: float = 0.0) -> np.ndarray:
    """Positions of the corners of the convex hull, anticlockwise from the westmost. Points on an edge, to within rounding (a
    10^-12 of the extent), are dropped; with ``slack``, they are kept if they are within it (twice the area of their triangle).
    Equal points count once."""
    at = x.tolist()
    order = sorted(range(len(at)), key=at.__getitem__) if len(at) < 100 else np.lexsort((np.arange(len(x)), x[:, 1], x[:, 0])).tolist()
    rows = [q for k, q in enumerate(order) if not k or at[q] != at[order[k - 1]]]
    if len(rows) <= 2:
        return np.array(rows, int)
    high = [p[1] for p in at]
    least = -slack if slack else 1e-12 * ((at[rows[-1]][0] - at[rows[0]][0]) * (max(high) - min(high)))

    def side(rows: list[int]) -> list[int]:
        out: list[int] = []
        for q in rows:
            while len(out) > 1:
                (ax, ay), (bx, by), (cx, cy) = at[out[-2]], at[out[-1]], at[q]
                if (bx - ax) * (cy - by) - (by - ay) * (cx - bx) > least:
                    break
                out.pop()
            out.append(q)
        return out

    ring = side(rows)[:-1] + side(rows[::-1])[:-1]
    return np.array(list(dict.fromkeys(ring)), int)


def hull(x: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, anticlockwise; points on an edge are dropped."""
    return x[on_hull(x)]


def hull_area(x: np.ndarray) -> float:
    """Area of the hull; of two points, their squared distance; of one, 0."""
    h = hull(x)
    if len(h) < 3:
        return float(((h[0] - h[1]) ** 2).sum()) if len(h) == 2 and len({*map(tuple, x.tolist())}) == 2 else 0.0
    before = np.concatenate([h[-1:], h[:-1]])
    return float(abs(np.dot(h[:, 0], before[:, 1].copy()) - np.dot(h[:, 1], before[:, 0].copy())) / 2)


def area_expansion(threshold_km2: float, least: int, most: int, degrees: bool = False) -> Kernel:
    """From the westmost free point a group takes the point that adds least hull area, while that is within the threshold.

    Groups under ``least`` are given up and their seed is not tried again.
    """

    def run(lat, lng, km):
        x, out = np.column_stack([lng, lat]) if degrees else plane(lat, lng), []
        free, places = np.ones(len(lat), bool), Places(lat, lng, x.T)
        slack = 1e-12 * (1.0 + float(np.abs(x).max(initial=0.0)) ** 2)
        for seed in np.argsort(lng, kind="stable").tolist():
            if not free[seed]:
                continue
            g, now = [seed], 0.0
            places.take(seed)
            while len(g) < most and places.left:
                area, i = _least_hull(x, g, places, slack)
                if area - now > threshold_km2:
                    break
                g.append(i)
                places.take(i)
                now = area
            if len(g) >= least:
                free[g] = False
                out.append(g)
            else:
                for i in g:
                    places.give_back(i)
        return out

    return run


def _edges(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h[1:], h[:1]]) - h


def _turns(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each edge of a ring, twice the area of its triangles with points: over 0 to its left. ``p`` has a row for each dimension."""
    edge = _edges(h)
    return edge[:, :1] * (p[1] - h[:, 1:]) - edge[:, 1:] * (p[0] - h[:, :1])


def _most_left(h: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most of :func:`_turns` in boxes; with ``low`` and ``high`` changed over, the least."""
    edge = _edges(h)
    up, back = edge[:, :1], edge[:, 1:]
    return up * (np.where(up > 0, high[1], low[1]) - h[:, 1:]) - back * (np.where(back > 0, low[0], high[0]) - h[:, :1])


def _added(h: np.ndarray, turn: np.ndarray, slack: float) -> np.ndarray:
    """What points add to the area of a hull of two corners or more, from the edges that they see."""
    # of two corners both edges are the same line, and what lies on it may count as a square or as nothing
    return np.where(np.abs(turn[0]) <= slack, 0.0, np.abs(turn[0])) / 2 if len(h) == 2 else np.maximum(0.0, -turn).sum(0) / 2


def _may_be_least(h: np.ndarray, places: Places, slack: float) -> np.ndarray:
    """Of the points that are left those that may add least to a hull, in ascending order, and others; of two corners, those that
    may be least of what is off their line, too. Boxes tell what the points in them add at least."""
    if len(h) == 1:
        bounds, value = places.outside(h.T), lambda p: ((p - h.T) ** 2).sum(0)
    elif len(h) == 2:
        bounds = np.maximum(0.0, np.maximum(_most_left(h, places.high, places.low)[0], -_most_left(h, places.low, places.high)[0])) / 2

        def value(p: np.ndarray) -> np.ndarray:
            more = _added(h, _turns(h, p), slack)
            return np.where(more > 0, more, np.inf)
    else:
        bounds, value = _added(h, _most_left(h, places.low, places.high), slack), lambda p: _added(h, _turns(h, p), slack)
    return np.sort(places.lowest[places.search(bounds, value, lambda v: v + 4 * slack)])


def _least_hull(x: np.ndarray, g: list[int], places: Places, slack: float) -> tuple[float, int]:
    """The least ``hull_area`` of ``g`` and one of the points that are left, and the lowest such one.

    What a point adds is told for all at once that may add least; the area itself is taken of those that rounding does
    not tell from the least, and of points clearly inside only of the first: they all leave the hull as it is.
    """
    h = hull(x[g])
    rest = _may_be_least(h, places, slack)
    p = x[rest].T
    inside = np.zeros(len(rest), bool)
    if len(h) == 1:
        more = ((p - h.T) ** 2).sum(0)
    else:
        turn = _turns(h, p)
        more = _added(h, turn, slack)
        inside = (turn > slack).all(0) if len(h) > 2 else inside
    asked = np.flatnonzero((more <= more.min() + slack) & ~inside)
    if len(h) == 2:  # a square may be more than a triangle: the best of both kinds
        on = np.abs(turn[0]) <= slack
        off = np.flatnonzero(~on)
        asked = np.append(np.flatnonzero(on), off[more[off] <= more[off].min() + slack] if len(off) else off)
    asked = np.append(asked, np.flatnonzero(inside)[:1])
    best = (np.inf, -1)
    for i in sorted(rest[asked].tolist()):
        best = min(best, (hull_area(x[[*g, i]]), i))
        if best[0] == 0.0:  # there is no less
            break
    return best


def enclosing_circle(x: np.ndarray) -> tuple[float, float, float]:
    """The least circle around points, by moving offenders to its border; deterministic, no recursion."""

    def over(a, b):
        c = (a + b) / 2
        return c, float(np.hypot(*(a - c)))

    def through(a, b, c):
        (bx, by), (cx, cy) = b - a, c - a  # from a on, so that far places lose no digits
        d = 2 * (bx * cy - by * cx)
        if abs(d) < 1e-10:
            return max((over(a, b), over(a, c), over(b, c)), key=lambda t: t[1])
        o = np.array([cy * (bx * bx + by * by) - by * (cx * cx + cy * cy), bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)]) / d
        return a + o, float(np.hypot(*o))

    if not len(x):
        return 0.0, 0.0, 0.0
    outside = lambda t, p: np.hypot(*(p - t[0])) > t[1] + 1e-10
    best = (x[0], 0.0)
    for i, p in enumerate(x):
        if outside(best, p):
            best = (p, 0.0)
            for j, q in enumerate(x[:i]):
                if outside(best, q):
                    best = over(p, q)
                    for r in x[:j]:
                        if outside(best, r):
                            best = through(p, q, r)
    return float(best[0][0]), float(best[0][1]), best[1]


def _lens(d: float, r: float, s: float) -> float:
    if d >= r + s:
        return 0.0
    if d <= abs(r - s):
        return float(np.pi * min(r, s) ** 2)
    unit = lambda v: float(np.clip(v, -1, 1))
    a = r * r * np.arccos(unit((d * d + r * r - s * s) / (2 * d * r))) + s * s * np.arccos(unit((d * d + s * s - r * r) / (2 * d * s)))
    return float(a - np.sqrt(max(0.0, (-d + r + s) * (d + r - s) * (d - r + s) * (d + r + s))) / 2)


def compact_circles(k: int, least: int, most: int, rounds: int = 50, penalty: float = 5.0, weight: float = 0.8, neighbours: int = 3, squared: bool = True, post_rounds: int = 20, tolerance: float = 1e-6, per_move: int = 5) -> Kernel:
    """K groups of bounded size whose least enclosing circles are small, apart and disjoint.

    K-means start (the seed of least separation term), repair of sizes, moves to adjacent groups while the cost falls, then
    points of the deepest overlaps handed over. Cost: circle areas + penalty x overlap (squared) + weight x separation.
    """

    def run(lat, lng, km):
        n = len(lat)
        lo = max(1, least)
        hi, kk = max(lo, most), max(1, min(k, n // lo if n >= lo else 1))
        x = np.column_stack([lat, lng])

        def centres(label: np.ndarray) -> np.ndarray:
            return np.array([x[label == g].mean(0) if (label == g).any() else x.mean(0) for g in range(kk)])

        def spread(c: np.ndarray, corners: list[np.ndarray]) -> float:
            """The separation term of centres and of the points that may be farthest from them."""
            r = [np.sqrt(((x[own] - c[g]) ** 2).sum(1)).max() if len(own) else 0.0 for g, own in enumerate(corners)]
            return sum((r[a] + r[b]) / d for a in range(kk) for b in range(a) if (d := np.hypot(*(c[a] - c[b]))) > 0)

        def separation(label: np.ndarray) -> float:
            return spread(centres(label), [np.flatnonzero(label == g) for g in range(kk)])

        def corner(own: np.ndarray) -> np.ndarray:
            """The corners of the hull of ``own``, in index order. Nothing else bears on circle or radius."""
            return np.sort(own[on_hull(x[own])])

        def rings(label: np.ndarray) -> list[tuple[float, float, float]]:
            return [enclosing_circle(x[corner(np.flatnonzero(label == g))]) for g in range(kk)]

        def overlaps(found) -> list[tuple[float, int, int]]:
            return [(_lens(float(np.hypot(found[a][0] - found[b][0], found[a][1] - found[b][1])), found[a][2], found[b][2]), b, a) for a in range(kk) for b in range(a)]

        def cost(found, c: np.ndarray, corners: list[np.ndarray]) -> float:
            shared = sum(o for o, _, _ in overlaps(found))
            return float(np.pi * sum(f[2] ** 2 for f in found) + penalty * shared ** (2 if squared else 1) + weight * spread(c, corners))

        label = min((lloyd(x, kk, seed=s) for s in range(5)), key=separation).copy()
        for _ in range(100):  # sizes
            size, c = np.bincount(label, minlength=kk), centres(label)
            over, under = np.flatnonzero(size > hi), np.flatnonzero(size < lo)
            if len(over):
                to = np.flatnonzero(size < hi)
                if not len(to):
                    break
                own = np.flatnonzero(label == over[0])
                at, g = np.unravel_index(((x[own][:, None] - c[to]) ** 2).sum(-1).argmin(), (len(own), len(to)))
                i, g = own[at], to[g]
            elif len(under):
                giving = np.flatnonzero(size[label] > lo)
                if not len(giving):
                    break
                g = int(under[0])
                i = giving[((x[giving] - c[g]) ** 2).sum(1).argmin()]
            else:
                break
            label[i] = g
        size, sums = np.bincount(label, minlength=kk), np.array([x[label == g].sum(0) for g in range(kk)])
        corners = [corner(np.flatnonzero(label == g)) for g in range(kk)]
        found = [enclosing_circle(x[own]) for own in corners]
        centre = lambda: np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x.mean(0))
        best, best_cost = label.copy(), cost(found, centres(label), corners)
        now = best_cost
        for _ in range(rounds):  # moves
            c, moved = centres(label), False
            sums = np.array([x[label == g].sum(0) for g in range(kk)])
            near = [{int(b) for b in np.argsort([np.hypot(*(c[a] - c[b])) if a != b else np.inf for b in range(kk)], kind="stable")[: min(neighbours, kk - 1)]} for a in range(kk)]
            near = [near[a] | {b for b in range(kk) if a in near[b]} for a in range(kk)]
            for i in range(n):
                a = label[i]
                if size[a] <= lo:
                    continue
                less = None
                for b in sorted(near[a]):
                    if size[b] < hi:
                        if less is None:  # the group without the point; only a corner changes it
                            left = corner(np.flatnonzero((label == a) & (np.arange(n) != i))) if i in corners[a] else corners[a]
                            less = left, enclosing_circle(x[left]) if left is not corners[a] else found[a]
                        more = corner(np.append(corners[b], i))
                        more = corners[b] if i not in more else more
                        then, rims = list(corners), list(found)
                        then[a], rims[a] = less
                        then[b], rims[b] = more, enclosing_circle(x[more]) if more is not corners[b] else found[b]
                        size[a], size[b], sums[a], sums[b] = size[a] - 1, size[b] + 1, sums[a] - x[i], sums[b] + x[i]
                        if (after := cost(rims, centre(), then)) < now - 1e-4:
                            label[i], corners, found = b, then, rims
                            now, moved = after, True
                            break
                        size[a], size[b], sums[a], sums[b] = size[a] + 1, size[b] - 1, sums[a] + x[i], sums[b] - x[i]
            if now < best_cost:
                best, best_cost = label.copy(), now
            if not moved:
                break
        label = best.copy()

        def shared(label: np.ndarray, g: int, circle: tuple) -> list[int]:
            """The members of g in a circle, from its centre outwards."""
            own = np.flatnonzero(label == g)
            away = np.hypot(x[own, 0] - circle[0], x[own, 1] - circle[1])
            own, away = own[away <= circle[2]], away[away <= circle[2]]
            return own[np.argsort(away, kind="stable")].tolist()

        for _ in range(post_rounds):  # overlaps
            found = rings(label)
            deep = [t for t in sorted(overlaps(found), reverse=True) if t[0] > tolerance]
            if not deep:
                break
            before, kept = sum(t[0] for t in deep), label.copy()
            for _, a, b in deep:
                for g, h in ((a, b), (b, a)):
                    size = np.bincount(label, minlength=kk)
                    inside, theirs = shared(label, g, found[h]), shared(label, h, found[g])
                    if size[h] >= hi and (g, h) == (a, b):  # a full neighbour gives a point for each that it takes
                        some = min(per_move, len(inside), len(theirs))
                        label[inside[:some]], label[theirs[:some]] = h, g
                    else:
                        label[inside[: max(0, min(per_move, size[g] - lo, hi - size[h]))]] = h
            if sum(t[0] for t in overlaps(rings(label))) >= before:
                label = kept
                break
        return [np.flatnonzero(label == g).tolist() for g in range(kk)]

    return run
