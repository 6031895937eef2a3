"""SQL of whole plans, for DuckDB: tours, groups and days step by step in recursive queries over small problems.

``pts`` has the points (``problem_id, point_idx, lat, lng``) and ``dist`` all distances both ways (``problem_id, i, j, km``).
Every piece is a list of common table expressions.
"""

from __future__ import annotations

from . import fixtures as fx

DIST = fx.SQL_PAIRS + ", " + fx.SQL_BOTH + ", dist as (select * from both_ways)"
DIST_ROAD = (
    fx.SQL_PAIRS.replace("pairs as", "plain as") + ", " + fx.SQL_ROAD + ", pairs as (select p.problem_id,p.i,p.j,coalesce(round(km*detour,8),km) as km from plain p left join road r on r.problem_id=p.problem_id and r.i=p.i and r.j=p.j), "
    + fx.SQL_BOTH + ", dist as (select * from both_ways)"
)

#: Nearest-neighbour walks over ``{groups}`` (``problem_id, label, seq, point_idx``), each from its first by seq and index.
_WALK = """
 {out} as (
  select problem_id, label, 1 as stop_seq, arg_min(point_idx, (seq, point_idx)) as point_idx, [arg_min(point_idx, (seq, point_idx))] as seen from {groups} group by 1,2
  union all
  select problem_id, label, stop_seq, point_idx, seen from (
   select w.problem_id, w.label, w.stop_seq+1 as stop_seq, b.point_idx, list_append(w.seen,b.point_idx) as seen,
    row_number() over (partition by w.problem_id, w.label order by d.km, b.seq, b.point_idx) as n
   from {out} w join {groups} b on b.problem_id=w.problem_id and b.label=w.label and not list_contains(w.seen,b.point_idx)
   join dist d on d.problem_id=w.problem_id and d.i=w.point_idx and d.j=b.point_idx) where n=1)"""

#: 2-opt of the walks: one pair of places a step, from the second place on; at the end of a sweep again if it bettered.
_TWO_OPT = """
 {out}_steps as (
  select problem_id, label, list(point_idx order by stop_seq) as tour, 2 as i, 3 as j, false as better, count(*)<=2 as done from {walk} group by 1,2
  union all
  select problem_id, label, case when hit then tour[:i-1] || list_reverse(tour[i:j]) || tour[j+1:] else tour end,
   case when j<n then i when i<n-1 then i+1 else 2 end, case when j<n then j+1 when i<n-1 then i+2 else 3 end,
   case when j<n or i<n-1 then better or hit else false end, j=n and i>=n-1 and not (better or hit)
  from (
   select o.*, len(tour) as n, ac.km+bd.km < ab.km+cd.km-1e-9 as hit from {out}_steps o
   join dist ac on ac.problem_id=o.problem_id and ac.i=tour[o.i-1] and ac.j=tour[o.j] join dist bd on bd.problem_id=o.problem_id and bd.i=tour[o.i] and bd.j=tour[o.j%len(tour)+1]
   join dist ab on ab.problem_id=o.problem_id and ab.i=tour[o.i-1] and ab.j=tour[o.i] join dist cd on cd.problem_id=o.problem_id and cd.i=tour[o.j] and cd.j=tour[o.j%len(tour)+1]
   where not done)),
 {out} as (select problem_id, label, stop_seq, tour[stop_seq] as point_idx from (select *, unnest(range(1,len(tour)+1)) as stop_seq from {out}_steps where done))"""

#: The shortest open path of each group of at most five: all orders, ties to the first by places.
_BEST_OPEN = """
 {out}_placed as (select *, row_number() over (partition by problem_id, label order by seq, point_idx) as place, count(*) over (partition by problem_id, label) as n from {groups}),
 {out}_paths as (
  select problem_id, label, n, [place] as places, [point_idx] as tour, 0e0 as km from {out}_placed
  union all
  select p.problem_id, p.label, p.n, list_append(p.places, b.place), list_append(p.tour, b.point_idx), p.km+d.km
  from {out}_paths p join {out}_placed b on b.problem_id=p.problem_id and b.label=p.label and not list_contains(p.places, b.place)
  join dist d on d.problem_id=p.problem_id and d.i=p.tour[-1] and d.j=b.point_idx),
 {out} as (
  select problem_id, label, stop_seq, tour[stop_seq] as point_idx from (
   select *, unnest(range(1,len(tour)+1)) as stop_seq from (select *, row_number() over (partition by problem_id, label order by case when n<=2 then 0 else round(km,6) end, places) as r from {out}_paths where len(tour)=n) where r=1))"""

#: A tour cut into days: five stops, {seconds} s in the field, 15 minutes a stop, 35 km/h.
_SPLIT = """
 {out}_way as (select w.problem_id, w.stop_seq, w.point_idx, coalesce(d.km,0) as km from {tour} w left join {tour} v on v.problem_id=w.problem_id and v.stop_seq=w.stop_seq-1
  left join dist d on d.problem_id=w.problem_id and d.i=v.point_idx and d.j=w.point_idx),
 {out} as (
  select problem_id, stop_seq, point_idx, 1 as day, 1 as n, 900e0 as sec from {out}_way where stop_seq=1
  union all
  select w.problem_id, w.stop_seq, w.point_idx, case when s.n+1<=5 and s.sec+w.km/35*3600+900<={seconds} then s.day else s.day+1 end,
   case when s.n+1<=5 and s.sec+w.km/35*3600+900<={seconds} then s.n+1 else 1 end, case when s.n+1<=5 and s.sec+w.km/35*3600+900<={seconds} then s.sec+w.km/35*3600+900 else 900e0 end
  from {out} s join {out}_way w on w.problem_id=s.problem_id and w.stop_seq=s.stop_seq+1)"""

#: Days of ``{stops}`` (``problem_id, day, n, point_idx``).
_DAYS = """
 {out}_km as (select s.problem_id, s.day, count(*) as point_count, round(sum(coalesce(d.km,0)),6) as km from {stops} s left join {stops} v on v.problem_id=s.problem_id and v.day=s.day and v.n=s.n-1
  left join dist d on d.problem_id=s.problem_id and d.i=v.point_idx and d.j=s.point_idx group by 1,2),
 {out} as (select problem_id, day, point_count, round(km,1) as drive_distance_km, round(km/35*60,1) as drive_time_min, round(point_count*15.0e0,1) as stop_time_min,
  round((km/35*60+point_count*15.0e0+155)/60,1) as total_time_hours from {out}_km)"""

_METRICS = """
 {out} as (select problem_id, count(*) as total_days, cast(sum(point_count) as bigint) as total_points, round(sum(drive_distance_km),6) as total_distance_km, round(sum(total_time_hours),6) as total_hours,
  max(point_count) as max_day_points, round(sum(drive_distance_km)/count(*),6) as avg_day_distance, count(*) filter (total_time_hours>4) as overtime_days from {days} group by problem_id)"""


def _fill(text: str, **names: str) -> str:
    for k, v in names.items():
        text = text.replace("{" + k + "}", v)
    return text


def tour(out: str, points: str = "pts", sweeps: bool = True) -> str:
    """``{out}``: the tour of each problem of ``points``."""
    parts = [f" {out}_groups as (select problem_id, 0 as label, 0 as seq, point_idx from {points})", _fill(_WALK, out=f"{out}_walk", groups=f"{out}_groups")]
    return ",".join([*parts, _fill(_TWO_OPT, out=out, walk=f"{out}_walk") if sweeps else f" {out} as (select problem_id, label, stop_seq, point_idx from {out}_walk)"])


def plan(name: str, sweeps: bool = True) -> str:
    """``{name}``: the figures of a plan whose tour ``{name}_tour`` (or groups ``{name}_groups``) are made before."""
    return ",".join([_fill(_DAYS, out=f"{name}_days", stops=f"{name}_stops"), _fill(_METRICS, out=name, days=f"{name}_days")])


def tsp(name: str = "tsp") -> str:
    return ",".join([tour(f"{name}_tour"), _fill(_SPLIT, out=f"{name}_stops", tour=f"{name}_tour", seconds="5100"), plan(name)])


def of_groups(name: str, groups: str, whole: bool) -> str:
    """A day for each group of ``groups`` (``problem_id, label, seq, point_idx``)."""
    path = _fill(_BEST_OPEN, out=f"{name}_path", groups=groups) if whole else _fill(_WALK, out=f"{name}_path", groups=groups)
    return ",".join([path, f" {name}_stops as (select problem_id, label+1 as day, stop_seq as n, point_idx from {name}_path)", plan(name)])


#: Groups of five: the next point is the one nearest to the group's mean, the first of a group the one farthest from the mean of what is left.
CENTROID = """
 {out} as (
  select problem_id, point_idx, 0 as label, 0 as seq, [point_idx] as seen, [point_idx] as own from (
   select b.problem_id, b.point_idx, row_number() over (partition by b.problem_id order by {first} desc, b.point_idx) as n from {points} b) where n=1
  union all
  select problem_id, point_idx, label, seq, seen, own from (
   select g.problem_id, b.point_idx, case when g.seq=4 then g.label+1 else g.label end as label, case when g.seq=4 then 0 else g.seq+1 end as seq,
    list_append(g.seen,b.point_idx) as seen, case when g.seq=4 then [b.point_idx] else list_append(g.own,b.point_idx) end as own,
    row_number() over (partition by g.problem_id order by case when g.seq=4 then -{seed} else {grow} end, b.point_idx) as n
   from {out} g join {points} b on b.problem_id=g.problem_id and not list_contains(g.seen,b.point_idx)) where n=1)"""
_TO_MEAN = "(select " + fx.SQL_KM.format(a="b", b="m") + " from (select avg(q.lat) as lat, avg(q.lng) as lng from {points} q where q.problem_id=b.problem_id and {of}) m)"


def centroid_groups(out: str, points: str) -> str:
    at = lambda of: _TO_MEAN.replace("{of}", of).replace("{points}", points)
    return _fill(CENTROID, out=out, points=points, first=at("true"), seed=at("not list_contains(g.seen,q.point_idx)"), grow=at("list_contains(g.own,q.point_idx)"))


ACTIVE = " active as (select p.* from pts p join (select problem_id, i, min(km) as km from dist group by 1,2 having min(km)<=5 union all select problem_id, min(point_idx), 0 from pts group by problem_id having count(*)=1) a on a.problem_id=p.problem_id and a.i=p.point_idx)"
RIVER = " river as (select problem_id, point_idx, 0 as seq, cast(floor((r-1)/ceil(n/ceil(n/5.0e0))) as int) as label from (select *, row_number() over (partition by problem_id order by lng,point_idx) as r, count(*) over (partition by problem_id) as n from pts))"
DENSE = """
 near as (select problem_id,i,j from dist where km<=5),
 core as (select problem_id, i as p from near group by 1,2 having count(*)+1>=3),
 links as (select n.problem_id,i,j from near n join core a on a.problem_id=n.problem_id and a.p=i join core b on b.problem_id=n.problem_id and b.p=j),
 reach as (select problem_id, p as a, p as b from core union select r.problem_id, r.a, l.j from reach r join links l on l.problem_id=r.problem_id and l.i=r.b),
 low as (select problem_id, a as p, min(b) as low from reach group by 1,2),
 numbered as (select problem_id, p, dense_rank() over (partition by problem_id order by low)-1 as label from low),
 border as (select n.problem_id, n.i as p, min(label) as label from near n join numbered c on c.problem_id=n.problem_id and c.p=n.j group by 1,2),
 dense as (select t.problem_id, point_idx, 0 as seq, cast(coalesce(c.label,b.label) as int) as label from pts t left join numbered c on c.problem_id=t.problem_id and c.p=point_idx
  left join border b on b.problem_id=t.problem_id and b.p=point_idx where coalesce(c.label,b.label) is not null)"""


def query(*parts: str, end: str) -> str:
    return "with recursive " + ",".join([fx.SQL_MANY, *parts]) + " " + end


def cluster(name: str = "clusters") -> str:
    return ",".join([ACTIVE, centroid_groups(f"{name}_groups", "active"), of_groups(name, f"{name}_groups", True)])


def fence(name: str = "fences") -> str:
    return ",".join([RIVER, of_groups(name, "river", True)])


def dbscan(name: str = "dbscans") -> str:
    return ",".join([DENSE, of_groups(name, "dense", False)])


TOUR_TWO_OPT = query(DIST, tour("best"), end="select problem_id, cast(stop_seq as int) as stop_seq, point_idx from best")
GROUP_BEST = query(DIST, centroid_groups("groups", "pts"), _fill(_BEST_OPEN, out="best", groups="groups"), end="select problem_id, cast(label as int) as label, cast(stop_seq as int) as stop_seq, point_idx from best")
PLANS = {
    "plan_tsp": query(DIST, tsp(), end="select * from tsp"),
    "plan_tsp_road": query(DIST_ROAD, tsp(), end="select * from tsp"),
    "plan_cluster": query(DIST, cluster(), end="select * from clusters"),
    "plan_cluster_road": query(DIST_ROAD, cluster(), end="select * from clusters"),
    "plan_fence": query(DIST, fence(), end="select * from fences"),
    "plan_dbscan": query(DIST, dbscan(), end="select * from dbscans"),
    "plan_dbscan_road": query(DIST_ROAD, dbscan(), end="select * from dbscans"),
    "plan_road_network": query(DIST, dbscan(), end="select * from dbscans"),
}
_FIGURES = ("total_days", "total_points", "total_distance_km", "total_hours", "max_day_points", "avg_day_distance", "overtime_days")
_FIGURE_ROWS = lambda *of: " figures as (" + " union all ".join(f"select problem_id, '{s}' as strategy, '{m}' as metric, cast({m} as double) as value from {t}" for s, t in of for m in _FIGURES) + ")"
COMPARED = query(
    DIST, tsp(), cluster(), fence(),
    _FIGURE_ROWS(("tsp", "tsp"), ("cluster", "clusters"), ("fence", "fences")),
    end="select problem_id, metric, " + ", ".join(f"max(value) filter (strategy='{s}') as {s}" for s in ("tsp", "cluster", "fence")) + " from figures group by 1,2",
)
DIFFERENCES = query(
    DIST, tsp(), fence(), _FIGURE_ROWS(("tsp", "tsp"), ("fence", "fences")),
    end="select problem_id, metric, tsp, fence, round(fence-tsp,6) as difference from (select problem_id, metric, max(value) filter (strategy='tsp') as tsp, max(value) filter (strategy='fence') as fence from figures group by 1,2)",
)

#: Pairs by distance, one a step; two groups become one if together they have at most six points.
CAPPED_LINK = query(
    DIST,
    """ n as (select *, row_number() over (partition by problem_id order by point_idx) as place, count(*) over (partition by problem_id) as size from pts),
 e as (select p.problem_id, a.place as x, b.place as y, row_number() over (partition by p.problem_id order by km, i, j) as step from pairs p join n a on a.problem_id=p.problem_id and a.point_idx=i join n b on b.problem_id=p.problem_id and b.point_idx=j where km<=25),
 grow as (
  select problem_id, range(1, any_value(size)+1) as owner, 0 as step from n group by problem_id
  union all
  select g.problem_id, case when owner[x]<>owner[y] and len(list_filter(owner, lambda o: o=owner[x] or o=owner[y]))<=6
   then list_transform(owner, lambda o: case when o=greatest(owner[x],owner[y]) then least(owner[x],owner[y]) else o end) else owner end, e.step from grow g join e on e.problem_id=g.problem_id and e.step=g.step+1),
 last as (select problem_id, arg_max(owner, step) as owner from grow group by 1),
 told as (select n.problem_id, point_idx, owner[place] as o from n join last using (problem_id))""",
    end="select problem_id, point_idx, cast(dense_rank() over (partition by problem_id order by o)-1 as int) as label, cast(row_number() over (partition by problem_id, o order by point_idx)-1 as int) as seq from told",
)

#: Corners of the areas of days: of three stops or more those of the hull, else a circle.
REGIONS = query(
    DIST, tour("best", sweeps=False), _fill(_SPLIT, out="split", tour="best", seconds="5100"),
    """ spots as (select s.problem_id, s.day, s.point_idx, lat, lng from split s join pts p on p.problem_id=s.problem_id and p.point_idx=s.point_idx),
 ext as (select problem_id, day, count(*) as n, avg(lat) as mla, avg(lng) as mln, 1e-12*(max(lat)-min(lat))*(max(lng)-min(lng)) as e, sqrt(pow(max(lat)-min(lat),2)+pow(max(lng)-min(lng),2))/2 as half from spots group by 1,2),
 corner as (select distinct a.problem_id, a.day, a.lat, a.lng from spots a join spots b on b.problem_id=a.problem_id and b.day=a.day and b.point_idx<>a.point_idx join ext on ext.problem_id=a.problem_id and ext.day=a.day
  where n>=3 and not exists (select 1 from spots c where c.problem_id=a.problem_id and c.day=a.day and c.point_idx not in (a.point_idx,b.point_idx)
   and (b.lng-a.lng)*(c.lat-b.lat)-(b.lat-a.lat)*(c.lng-b.lng)<=e and ((b.lng-a.lng)*(c.lat-b.lat)-(b.lat-a.lat)*(c.lng-b.lng)<-e or (c.lng-a.lng)*(c.lng-b.lng)+(c.lat-a.lat)*(c.lat-b.lat)>0))),
 ring as (select problem_id, day, mla+r*sin(radians(k*10.0e0)) as lat, mln+r*cos(radians(k*10.0e0)) as lng from (select *, case n when 2 then half+0.002e0 else 0.3e0/111e0 end as r from ext where n<3), range(0,36) t(k))""",
    end="select problem_id, cast(day as int) as day, 'hull' as kind, round(lat,6) as lat, round(lng,6) as lng from corner union all select problem_id, cast(day as int), 'circle', round(lat,6), round(lng,6) from ring",
)

#: Points over 25 km from the depot go in groups of five, the first the farthest, cut in two days with a night at their middle.
_DEPOT = "(select 107.08e0 as lng, 29.85e0 as lat) d"
_FROM_DEPOT = fx.SQL_KM.format(a="p", b="d")
_NIGHTS = """
 depot as (select p.*, {km} as base_km from pts p, {depot}),
 close_by as (select * from depot where base_km<=25), far as (select * from depot where base_km>25),
 chain as (
  select problem_id, point_idx, 0 as label, 0 as seq, [point_idx] as seen from (select *, row_number() over (partition by problem_id order by base_km desc, point_idx) as n from far) where n=1
  union all
  select problem_id, point_idx, label, seq, seen from (
   select g.problem_id, b.point_idx, case when g.seq=4 then g.label+1 else g.label end as label, case when g.seq=4 then 0 else g.seq+1 end as seq, list_append(g.seen,b.point_idx) as seen,
    row_number() over (partition by g.problem_id order by case when g.seq=4 then -b.base_km else t.km end, b.point_idx) as n
   from chain g join far b on b.problem_id=g.problem_id and not list_contains(g.seen,b.point_idx) join dist t on t.problem_id=g.problem_id and t.i=g.point_idx and t.j=b.point_idx) where n=1)""".replace("{km}", _FROM_DEPOT).replace("{depot}", _DEPOT)
_NIGHT_DAYS = """
 hotel as (select problem_id, label, round(avg(lat),9) as lat, round(avg(lng),9) as lng from chain join pts using (problem_id, point_idx) group by 1,2),
 sized as (select *, count(*) over (partition by problem_id, label) as size from far_tour),
 halved as (select problem_id, label, case when size<=1 or stop_seq<=size//2 then 1 else 2 end as part, case when size<=1 or stop_seq<=size//2 then stop_seq else stop_seq-size//2 end as n, point_idx from sized),
 way as (select h.problem_id, h.label, h.part, h.n, max(h.n) over (partition by h.problem_id, h.label, h.part) as m, lat, lng, coalesce(t.km,0) as leg from halved h join pts p on p.problem_id=h.problem_id and p.point_idx=h.point_idx
  left join halved v on v.problem_id=h.problem_id and v.label=h.label and v.part=h.part and v.n=h.n-1 left join dist t on t.problem_id=h.problem_id and t.i=v.point_idx and t.j=h.point_idx),
 night_km as (select p.problem_id, p.label, p.part, count(*) as point_count, round(sum(leg + case when n=1 then case when part=1 then {base} else {stay} end else 0 end + case when n=m then case when part=1 then {stay} else {base} end else 0 end),6) as km
  from way p join hotel h on h.problem_id=p.problem_id and h.label=p.label, {depot} group by 1,2,3),
 all_days as (select problem_id, point_count, drive_distance_km, total_time_hours from single_days union all select problem_id, point_count, round(km,1), round((km/35*60+point_count*15.0e0)/60,1) from night_km)""".replace("{base}", _FROM_DEPOT).replace("{stay}", fx.SQL_KM.format(a="p", b="h")).replace("{depot}", _DEPOT)


def overnight() -> str:
    return ",".join([
        _NIGHTS, tour("single_tour", "close_by"), _fill(_SPLIT, out="single_stops", tour="single_tour", seconds="5100"), _fill(_DAYS, out="single_days", stops="single_stops"),
        _fill(_WALK, out="far_walk", groups="chain"), _fill(_TWO_OPT, out="far_tour", walk="far_walk"), _NIGHT_DAYS, _fill(_METRICS, out="overnights", days="all_days"),
    ])


PLANS["plan_overnight"] = query(DIST, overnight(), end="select * from overnights")
PLANS["plan_overnight_road"] = query(DIST_ROAD, overnight(), end="select * from overnights")
