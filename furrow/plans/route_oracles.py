"""DuckDB SQL for routes on aisles of any direction: areas filled side by side, and the smooth routes' program."""

from __future__ import annotations

from furrow.operators import smooth_route as s
from furrow.operators.sweep import OFFSET_STEP_M, SAMPLE_SPACING_M
from furrow.plans import tables as t

RES = f"{t.GRID_RESOLUTION}::double"
STRIPS = f"""select s_suppkey::int as aisle_id, [{t.AISLE_X0}::double, {t.AISLE_X1}, {t.AISLE_X1}, {t.AISLE_X0}] as px,
  [({t.AISLE_Y0})::double, {t.AISLE_Y0}, {t.AISLE_Y1}, {t.AISLE_Y1}] as py from supplier where {t.AISLE_Y1} <= (select max(y) from semantic)"""
_TURN = [f"case when s_suppkey % 2 = 1 then {119.0 - x}::double else {x}::double end" for x, _ in t.OBLIQUE]
OBLIQUE = f"""select s_suppkey::int as aisle_id, [{', '.join(_TURN)}] as px, [{', '.join(f'({t.OBLIQUE_Y} + {y}::double)::double' for _, y in t.OBLIQUE)}] as py
  from supplier where {t.OBLIQUE_Y} + {t.OBLIQUE_TOP} <= (select max(y) from semantic)"""


def covered(areas: str, name: str) -> str:
    """CTE ``name``(id, x, y): the cells of each of ``areas``(id, xs, ys), integer corners in order.

    A centre inside an odd number of sides, or a side drawn from cell to cell along its longer axis.
    """
    return f"""{name}_side as (select id, xs[k] as gx, ys[k] as gy, xs[k % len(xs) + 1] as hx, ys[k % len(ys) + 1] as hy from (select *, unnest(range(1, len(xs) + 1)) as k from {areas})),
{_filled(name)}"""


def _filled(name: str) -> str:
    return f"""{name}_box as (select id, min(gx)::int as x0, max(gx)::int as x1, min(gy)::int as y0, max(gy)::int as y1 from {name}_side group by id),
{name}_column as (select *, unnest(range(x0, x1 + 1))::int as x from {name}_box),
{name}_spot as (select *, unnest(range(y0, y1 + 1))::int as y from {name}_column),
{name}_in as (select p.id, p.x, p.y from {name}_spot p join {name}_side e on e.id = p.id and e.gy <> e.hy and (e.gy > p.y) <> (e.hy > p.y)
  where p.x < e.gx + (p.y - e.gy) * (e.hx - e.gx) / (e.hy - e.gy) group by p.id, p.x, p.y having count(*) % 2 = 1),
{name}_step as (select *, greatest(abs(hx - gx), abs(hy - gy)) as n, unnest(range(greatest(abs(hx - gx), abs(hy - gy))::int + 1))::double as i from {name}_side),
{name} as (select id, x, y from {name}_in union
  select id, floor(gx + i / greatest(n, 1) * (hx - gx) + 0.5::double)::int, floor(gy + i / greatest(n, 1) * (hy - gy) + 0.5::double)::int from {name}_step)"""


def hulls(areas: str, name: str) -> str:
    """CTE ``name``(id, x, y): the cells of the convex hull of each of ``areas``(id, xs, ys)."""
    return f"""{name}_point as (select distinct id, xs[k] as x, ys[k] as y from (select *, unnest(range(1, len(xs) + 1)) as k from {areas})),
{name}_side as (select p.id, p.x as gx, p.y as gy, q.x as hx, q.y as hy from {name}_point p join {name}_point q on q.id = p.id and (q.x <> p.x or q.y <> p.y)
  join {name}_point r on r.id = p.id group by all
  having bool_and((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) > 0
    or ((q.x - p.x) * (r.y - p.y) = (q.y - p.y) * (r.x - p.x) and (r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) between 0 and (q.x - p.x) ** 2 + (q.y - p.y) ** 2))),
{_filled(name)}"""


def grid(aisles: str, blocked: str = "base <> 254") -> str:
    """CTEs semantic, aisle, lay (the layers) and dist (squared distances), from the aisles' corners."""
    return f"""semantic as materialized (select {t.CELL["x"]} as x, {t.CELL["y"]} as y, {t.SPARSE_LABEL} as label from orders),
aisle as materialized ({aisles}),
aisle_area as (select aisle_id as id, list_transform(px, lambda v: round_even(v, 0)) as xs, list_transform(py, lambda v: round_even(v, 0)) as ys from aisle),
{covered("aisle_area", "lane")},
lay as materialized (select *, case when is_hard then 0 when label = 1 or is_aisle then 254 else 205 end as base from (
  select s.*, s.label in (2, 4, 6) as is_hard, s.label in (3, 5) as is_candidate, l.x is not null as is_aisle from semantic s left join (select distinct x, y from lane) l using (x, y))),
near as (select x, y, least(
    y - max(case when {blocked} then y end) over (partition by x order by y rows between unbounded preceding and current row),
    min(case when {blocked} then y end) over (partition by x order by y rows between current row and unbounded following) - y) as g from lay),
dist as (select a.x, a.y, min((a.x - b.x) * (a.x - b.x) + b.g * b.g)::bigint as d2 from near a join near b on a.y = b.y and b.g is not null group by a.x, a.y),
cell as materialized (select l.x, l.y, l.base, l.is_candidate, sqrt(d.d2::double) * {RES} as m from lay l left join dist d using (x, y)),
corner as (select *, 0.5::double * (px[1] + px[4]) as sx, 0.5::double * (py[1] + py[4]) as sy, 0.5::double * (px[2] + px[3]) - 0.5::double * (px[1] + px[4]) as dx,
  0.5::double * (py[2] + py[3]) - 0.5::double * (py[1] + py[4]) as dy from aisle),
turned as (select *, sqrt(dx * dx + dy * dy) as n, dx / sqrt(dx * dx + dy * dy) as ux, dy / sqrt(dx * dx + dy * dy) as uy from corner),
frame as materialized (select *, 'A' || lpad(aisle_id::varchar, 2, '0') as label, atan2(uy, ux) as yaw, n * {RES} as len,
  least(abs((px[4] - px[1]) * -uy + (py[4] - py[1]) * ux), abs((px[3] - px[2]) * -uy + (py[3] - py[2]) * ux)) * {RES} as wid from turned)"""


def offsets(footprint: list[tuple[float, float]] = t.FOOTPRINT) -> str:
    """CTE offs(aisle_id, k, o): the lateral offsets that fit; a multiple of the step, zero, or a bound."""
    right, left = max(0.0, -min(y for _, y in footprint)), max(0.0, max(y for _, y in footprint))
    step = f"{OFFSET_STEP_M}::double"
    return f"""reach as (select *, -(wid / 2.0::double) + {right}::double as low, wid / 2.0::double - {left}::double as high from frame),
every as (select aisle_id, low, high, unnest((case when low <= 0 and high >= 0 then [0.0::double] else [] end) || [low, high]
  || list_transform(range(1, 1 + greatest(0, floor((high + 1e-12::double) / {step})::bigint)), lambda k: k::double * {step})
  || list_transform(range(1, 1 + greatest(0, floor((1e-12::double - low) / {step})::bigint)), lambda k: -(k::double * {step}))) as v from reach where low <= high + 1e-12::double),
near_equal as (select distinct aisle_id, least(greatest(v, low), high) as v from every),
offs as materialized (select aisle_id, v as o, (row_number() over (partition by aisle_id order by v) - 1)::int as k from (
  select *, lag(v) over (partition by aisle_id order by v) as before from near_equal) where before is null or v - before > 1e-9::double)"""


def _turned(footprint: list[tuple[float, float]], x: str, y: str, yaw: str) -> tuple[str, str]:
    xs = ", ".join(f"{x} + (cos({yaw}) * {a}::double - sin({yaw}) * {b}::double) / {RES}" for a, b in footprint)
    ys = ", ".join(f"{y} + (sin({yaw}) * {a}::double + cos({yaw}) * {b}::double) / {RES}" for a, b in footprint)
    return f"[{xs}]", f"[{ys}]"


_ROUND = "list_transform({0}, lambda v: round_even(v, 0)) as {0}s"
_LEAVES = "list_min(vx) < 0 or list_max(vx) > (select max(x) from lay) or list_min(vy) < 0 or list_max(vy) > (select max(y) from lay) as leaves"


def met(poses: str, footprint: list[tuple[float, float]], allow_unknown: bool = False, clip: bool = False) -> str:
    """CTE judged: ``poses``(id, x, y, yaw, …) with what each footprint meets; ``clip`` as in the centreline check."""
    xs, ys = _turned(footprint, "x", "y", "yaw")
    outside = "leaves" if clip else "leaves or n = 0"
    near = "case when n = 0 then 0.0::double else near end"
    return f"""body as materialized (select *, {xs} as vx, {ys} as vy from {poses}),
body_area as (select id, list_transform(vx, lambda v: round_even(v, 0)) as xs, list_transform(vy, lambda v: round_even(v, 0)) as ys from body),
{covered("body_area", "part")},
meets as (select p.id, count(c.base) as n, coalesce(bool_or(c.base = 0), false) as hit, coalesce(bool_or(c.base = 205), false) as unk, coalesce(bool_or(c.is_candidate), false) as cand, min(c.m) as near
  from part p left join cell c using (x, y) group by p.id),
judge as (select * exclude (vx, vy), {outside} as oob, {near if clip else f"case when {outside} then 0.0::double else {near} end"} as clear from (select *, {_LEAVES} from body) join meets using (id)),
judged as materialized (select *, case when oob then 'out_of_bounds' when hit then 'occupied' {'' if allow_unknown else "when unk then 'unknown'"} end as reason from judge)"""


def constant_routes(offset_rows: str, footprint: list[tuple[float, float]], allow_unknown: bool = False, clip: bool = False) -> str:
    """CTE routes: the metrics of each (aisle_id, offset_m) of ``offset_rows``."""
    rear, front = max(0.0, -min(x for x, _ in footprint)), max(0.0, max(x for x, _ in footprint))
    spacing = f"{SAMPLE_SPACING_M}::double"
    return f"""lane_route as (select f.*, q.offset_m, greatest(1, ceil(greatest(len - {rear}::double - {front}::double, 0) / {spacing})::int + 1) as count from frame f join ({offset_rows}) q using (aisle_id)),
lane_stop as (select *, unnest(range(count))::int as pose_idx from lane_route),
lane_place as (select *, case when pose_idx = count - 1 and count > 1 then len - {front}::double else {rear}::double + pose_idx::double * ((len - {front}::double - {rear}::double) / greatest(count - 1, 1)) end as d from lane_stop),
pose as materialized (select row_number() over () as id, aisle_id, label, offset_m, pose_idx, yaw, sx + ux * (d / {RES}) - uy * (offset_m / {RES}) as x, sy + uy * (d / {RES}) + ux * (offset_m / {RES}) as y from lane_place),
{met("pose", footprint, allow_unknown, clip)},
routes as (select aisle_id, label, offset_m, count(*)::bigint as pose_count, count(reason)::bigint as blocking_pose_count, count_if(hit)::bigint as collision_pose_count,
    count_if(unk)::bigint as unknown_overlap_pose_count, count_if(cand)::bigint as candidate_overlap_pose_count, count_if(oob)::bigint as out_of_bounds_pose_count,
    min(clear) as min_blocked_clearance_m, quantile_cont(clear, 0.1) as clearance_p10_m, avg(clear) as mean_clearance_m, count(reason) = 0 as passed,
    arg_min(reason, pose_idx) filter (where reason is not null) as first_failure_reason, arg_min(x, pose_idx) filter (where reason is not null) as first_failure_x from judged group by all)"""


def smooth(footprint: list[tuple[float, float]] = t.FOOTPRINT, allow_unknown: bool = False) -> str:
    """CTEs path (the program's routes), result (every aisle's outcome) and judged (the routes' sampled poses)."""
    rear, front = max(0.0, -min(x for x, _ in footprint)), max(0.0, max(x for x, _ in footprint))
    spacing, change = f"{s.CONTROL_SPACING_M}::double", f"{s.MAX_OFFSET_CHANGE_M}::double"
    ends = [_turned(footprint, f"x{k}", f"y{k}", "turn") for k in (0, 1)]
    where = [f"sx + ux * (d{k} / {RES}) - uy * (o{k} / {RES}) as x{k}, sy + uy * (d{k} / {RES}) + ux * (o{k} / {RES}) as y{k}" for k in (0, 1)]
    stops = "base = 0" if allow_unknown else "base in (0, 205)"
    near = f"case when p10 is null then 0.0::double else {s.CLEARANCE}::double / greatest(p10, {RES}) end"
    linear = "case when pose_idx = count - 1 then {1} else {0} + pose_idx::double * (({1} - {0}) / greatest(count - 1, 1)) end"
    return f"""span as (select *, greatest(2, ceil(greatest(len - {rear}::double - {front}::double, 0) / {spacing})::int + 1) as stations from frame),
station as materialized (select aisle_id, st, case when st = stations - 1 then len - {front}::double else {rear}::double + st::double * ((len - {front}::double - {rear}::double) / greatest(stations - 1, 1)) end as d
  from (select *, unnest(range(stations))::int as st from span)),
move as materialized (select row_number() over () as id, f.aisle_id, a.st as stage, p.k as i, q.k as j, p.o as o0, q.o as o1, a.d as d0, b.d as d1, f.sx, f.sy, f.ux, f.uy, f.yaw + atan2(q.o - p.o, b.d - a.d) as turn
  from frame f join station a using (aisle_id) join station b on b.aisle_id = f.aisle_id and b.st = a.st + 1 and b.d > a.d
  join offs p on p.aisle_id = f.aisle_id join offs q on q.aisle_id = f.aisle_id and abs(q.o - p.o) <= {change} + 1e-12::double),
moved as (select *, {where[0]}, {where[1]} from move),
swept as materialized (select id, {ends[0][0]} || {ends[1][0]} as vx, {ends[0][1]} || {ends[1][1]} as vy from moved),
swept_area as (select id, list_transform(vx, lambda v: round_even(v, 0)) as xs, list_transform(vy, lambda v: round_even(v, 0)) as ys from swept),
{hulls("swept_area", "swath")},
crossed as (select w.id, count(c.base) as n, coalesce(bool_or(c.{stops}), false) as hit, count_if(c.is_candidate) as cand, quantile_cont(c.m, 0.1) as p10 from swath w left join cell c using (x, y) group by w.id),
edge as materialized (select m.aisle_id, m.stage, m.i, m.j, m.o1 - m.o0 as change, abs(m.o0) as size_i, abs(m.o1) as size_j, {near} as price, c.cand
  from move m join crossed c using (id) join (select id, {_LEAVES} from swept) l using (id) where c.n > 0 and not c.hit and not l.leaves),
state(aisle_id, stage, i, j, cost, change, turn, path) as (
  select aisle_id, stage, i, j, price + {s.OFFSET}::double * (size_i + size_j) + {s.CHANGE}::double * abs(change) + {s.CANDIDATES}::double * cand, change,
    row_number() over (partition by aisle_id order by i, j), [i, j] from edge where stage = 0
  union all
  select aisle_id, stage, i, j, cost, change, row_number() over (partition by aisle_id order by met_first, j), path || [j] from (
    select *, row_number() over (partition by aisle_id, i, j order by cost, turn) as best, min(turn) over (partition by aisle_id, i) as met_first from (
      select e.aisle_id, e.stage, e.i, e.j, e.change, s.turn, s.path, s.cost + e.price + {s.OFFSET}::double * e.size_j + {s.CHANGE}::double * abs(e.change)
        + {s.BEND}::double * abs(e.change - s.change) + {s.CANDIDATES}::double * e.cand as cost from state s join edge e on e.aisle_id = s.aisle_id and e.stage = s.stage + 1 and e.i = s.j)) where best = 1),
path as materialized (select aisle_id, path from (select *, row_number() over (partition by aisle_id order by cost, turn) as best from state s join span p using (aisle_id) where s.stage = p.stations - 2) where best = 1),
result as materialized (select p.aisle_id, p.label, p.wid, p.len, p.stations, h.path is not null as passed, case when h.path is not null then null when r.far is null then 0 else r.far + 1 end as stuck
  from span p left join path h using (aisle_id) left join (select aisle_id, max(stage) as far from state group by aisle_id) r using (aisle_id)),
control as materialized (select c.aisle_id, c.k, o.o from (select aisle_id, unnest(path) as n, unnest(range(len(path)))::int as k from path) c join offs o on o.aisle_id = c.aisle_id and o.k = c.n),
leg as (select f.*, a.k as stage, x.d as d0, y.d as d1, a.o as o0, b.o as o1 from frame f join control a using (aisle_id) join control b on b.aisle_id = f.aisle_id and b.k = a.k + 1
  join station x on x.aisle_id = f.aisle_id and x.st = a.k join station y on y.aisle_id = f.aisle_id and y.st = a.k + 1),
leg_stop as (select *, unnest(range(count))::int as pose_idx from (select *, greatest(2, ceil((d1 - d0) / {SAMPLE_SPACING_M}::double)::int + 1) as count from leg)),
leg_place as (select *, {linear.format("d0", "d1")} as d, {linear.format("o0", "o1")} as o, atan2(o1 - o0, d1 - d0) as heading from leg_stop),
pose as materialized (select row_number() over () as id, aisle_id, stage, pose_idx, d, o, heading, yaw + heading as yaw, sx + ux * (d / {RES}) - uy * (o / {RES}) as x, sy + uy * (d / {RES}) + ux * (o / {RES}) as y from leg_place),
{met("pose", footprint, allow_unknown)},
measured as (select aisle_id, count(reason)::bigint as blocking_pose_count, count_if(hit)::bigint as collision_pose_count, count_if(unk)::bigint as unknown_overlap_pose_count,
    count_if(cand)::bigint as candidate_overlap_pose_count, count_if(oob)::bigint as out_of_bounds_pose_count, min(clear) filter (where stage = 0 or pose_idx > 0) as min_blocked_clearance_m,
    quantile_cont(clear, 0.1) filter (where stage = 0 or pose_idx > 0) as clearance_p10_m, max(abs(heading)) as max_heading_deviation_rad from judged group by aisle_id),
step as (select aisle_id, max(abs(v)) as max_offset_step_m from (select aisle_id, o - lag(o) over (partition by aisle_id order by k) as v from control) group by aisle_id)"""


_COUNTS = ("blocking_pose_count", "collision_pose_count", "unknown_overlap_pose_count", "candidate_overlap_pose_count", "out_of_bounds_pose_count")
_MEASURES = ("min_blocked_clearance_m", "clearance_p10_m", "max_heading_deviation_rad")
_REASON = "case when not r.passed then case when stuck > 0 then 'no_feasible_transition_at_station_' || (stuck + 1) else 'no_feasible_first_transition' end end"
_REGION = "case when not r.passed then case when stuck = 0 then 'entry' when stuck + 1 = stations - 1 then 'exit' else 'interior' end end"

SMOOTH = f"with recursive {grid(STRIPS)}, {offsets()}, {smooth()}"
SMOOTH_ROWS = f"""select r.aisle_id, r.label, round(wid, 6) as width_m, round(len, 6) as length_m, r.passed, {{0}}
  stations as control_point_count, (select count(*) from offs o where o.aisle_id = r.aisle_id)::int as tested_offset_count, {', '.join(f'coalesce({c}, 0)::bigint as {c}' for c in _COUNTS)},
  {', '.join(f'round({c}, 6) as {c}' for c in _MEASURES)}, case when r.passed then round(max_offset_step_m, 6) end as max_offset_step_m, {_REASON} as failure_reason, {_REGION} as failure_region,
  r.passed and coalesce(blocking_pose_count, 0) = 0 as sampled_passed from result r left join measured using (aisle_id) left join step using (aisle_id)"""
LANES = f"{grid(STRIPS)}, {offsets()}, {constant_routes('select aisle_id, o as offset_m from offs', t.FOOTPRINT)}"
BASELINE = f"(with {LANES} select aisle_id, bool_or(passed) as b1 from routes group by aisle_id)"
