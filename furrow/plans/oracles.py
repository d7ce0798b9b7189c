"""DuckDB SQL that computes, from the same tables, what the named queries compute. Aisles are axis-parallel here."""

from __future__ import annotations

from furrow.operators.sweep import OFFSET_STEP_M as STEP
from furrow.operators.sweep import SAMPLE_SPACING_M as SPACING
from furrow.plans import tables as t
from furrow.plans.queries import RADII

_POINTS = f"pts as (select {', '.join(f'{e} as {n}' for n, e in t.POINTS.items())} from lineitem)"
_RES = f"{t.POINT_RESOLUTION}::double"
_CELLS = f"""{_POINTS}, o as (select min(x) x0, min(y) y0 from pts),
binned as (select cast(floor((x - x0) / {_RES}) as int) x, cast(floor((y - y0) / {_RES}) as int) y, z from pts, o)"""


def _relative(kernel: int, source: str = "binned") -> str:
    before, after = kernel // 2, kernel - 1 - kernel // 2
    return f"""cells as (select x, y, min(z) h from {source} group by x, y),
rel as (select c.x, c.y, c.h, (select min(n.h) from cells n where n.x between c.x - {before} and c.x + {after} and n.y between c.y - {before} and c.y + {after}) ground from cells c)"""


_TRAV = "case when h - ground > 0.15::double then 2 else 1 end"


def _ground(condition: str, more: str = "") -> str:
    return f"""with {_POINTS}{more}
select {condition} as is_ground, count(*)::bigint as n, round(min(z), 6) as min_z, round(max(z), 6) as max_z from pts group by 1"""


def _histogram(bins: int) -> str:
    return f""", s as (select min(z) lo, max(z) hi from pts),
b0 as (select z, lo, hi, least(cast(floor((z - lo) * ({bins}::double / (hi - lo))) as int), {bins - 1}) k from pts, s),
b1 as (select z, lo, hi, case when z < lo + k * ((hi - lo) / {bins}::double) then k - 1
  when k < {bins - 1} and z >= (case when k + 1 = {bins} then hi else lo + (k + 1) * ((hi - lo) / {bins}::double) end) then k + 1 else k end as bin from b0),
hist as (select bin, lo + bin * ((hi - lo) / {bins}::double) as left_edge, count(*)::bigint as n from b1 group by bin, lo, hi)"""


_P10 = "(select quantile_cont(z, 0.1) from pts)"
_MODE = "(select left_edge from hist order by n desc, bin limit 1)"


def _ground_counts() -> str:
    parts = []
    for name, condition in (("height_threshold", f"z < {_P10} + 0.15::double"), ("morphological_pmf", f"z < {_MODE} + 0.25::double")):
        parts.append(f"""select trav, count(*)::bigint as cells, '{name}' as algorithm from (
with g as (select * from pts where {condition}), o as (select min(x) x0, min(y) y0 from g),
binned as (select cast(floor((x - x0) / {_RES}) as int) x, cast(floor((y - y0) / {_RES}) as int) y, z from g, o),
{_relative(5)} select {_TRAV} as trav from rel) group by trav""")
    return f"with {_POINTS}{_histogram(200)} " + " union all ".join(parts)


def _grid(label: str) -> str:
    return f"""semantic as (select {t.CELL["x"]} as x, {t.CELL["y"]} as y, {label} as label from orders),
aisle as (select s_suppkey::int as aisle_id, 'A' || lpad(s_suppkey::varchar, 2, '0') as label, {t.AISLE_Y0} as y0, {t.AISLE_Y1} as y1 from supplier
  where {t.AISLE_Y1} <= (select max(y) from semantic)),
lay as (select *, case when is_hard then 0 when label = 1 or is_aisle then 254 else 205 end as base from (
  select s.x, s.y, s.label, s.label in (2, 4, 6) as is_hard, s.label in (3, 5) as is_candidate, s.label = 6 as is_pillar,
    exists (select 1 from aisle a where s.x between {t.AISLE_X0} and {t.AISLE_X1} and s.y between a.y0 and a.y1) as is_aisle from semantic s))"""


def _distance(blocked: str) -> str:
    """Squared distances from every cell to the nearest blocked one: nearest in each column first, then over columns."""
    return f"""near as (select x, y, least(
    y - max(case when {blocked} then y end) over (partition by x order by y rows between unbounded preceding and current row),
    min(case when {blocked} then y end) over (partition by x order by y rows between current row and unbounded following) - y) as g from lay),
dist as (select a.x, a.y, min((a.x - b.x) * (a.x - b.x) + b.g * b.g)::bigint as d2 from near a join near b on a.y = b.y and b.g is not null group by a.x, a.y)"""


_MASK = f"m as (select {t.CELL['x']} as x, {t.CELL['y']} as y from orders where {t.MASK})"


def _regions(where: str, least: int) -> str:
    return f"""cells as (select x, y, y::bigint * 4294967296 + x as id from m where {where}),
reach(x, y, id) as (select x, y, id from cells union
  select c.x, c.y, r.id from reach r join cells c on abs(c.x - r.x) + abs(c.y - r.y) = 1 and c.id > r.id),
lab as (select x, y, min(id) as id from reach group by x, y),
up(x, y, id) as (select x, y, id from lab union select c.x, c.y, u.id from up u join cells c on abs(c.x - u.x) + abs(c.y - u.y) = 1 join lab l on l.x = c.x and l.y = c.y and l.id > u.id),
comp as (select x, y, min(id)::bigint as component from up group by x, y),
sized as (select *, count(*) over (partition by component)::bigint as size from comp),
kept as (select * from sized where size >= {least})"""


_F = {"front": max(x for x, _ in t.FOOTPRINT), "side": max(y for _, y in t.FOOTPRINT)}
_G = f"{t.GRID_RESOLUTION}::double"


def _axis_lengths() -> str:
    return f"frame as (select *, {t.AISLE_X1 - t.AISLE_X0}::double * {_G} as len, 4::double * {_G} as wid, (y0 + y1) / 2.0::double as cy from aisle)"


def _offsets() -> str:
    return f"""span as (select *, -(wid / 2.0::double) + {_F["side"]}::double as low, wid / 2.0::double - {_F["side"]}::double as high from frame),
raw as (select aisle_id, low, high, unnest([0.0::double, low, high] || list_transform(range(1, 1 + greatest(0, floor((high + 1e-12::double) / {STEP}::double)::bigint)), lambda k: k::double * {STEP}::double)
  || list_transform(range(1, 1 + greatest(0, floor((1e-12::double - low) / {STEP}::double)::bigint)), lambda k: -(k::double * {STEP}::double))) as v from span where low <= high + 1e-12::double),
clipped as (select distinct aisle_id, least(greatest(v, low), high) as v from raw),
offs as (select aisle_id, v as offset_m, (row_number() over (partition by aisle_id order by v) - 1)::int as k from (
  select *, lag(v) over (partition by aisle_id order by v) as before from clipped) where before is null or v - before > 1e-9::double)"""


def _sweep(offsets: str) -> str:
    """Poses of each (aisle, offset) of ``offsets`` and what their cells meet."""
    front, side = _F["front"], _F["side"]
    return f"""route as (select f.aisle_id, f.label, f.len, f.cy, q.offset_m from frame f join ({offsets}) q using (aisle_id)),
counted as (select *, greatest(1, ceil(greatest(len - {front}::double - {front}::double, 0) / {SPACING}::double)::int + 1) as n from route),
spot as (select *, unnest(range(n))::int as pose_idx from counted),
pose as (select *, {t.AISLE_X0}::double + 1.0::double * ((case when pose_idx = n - 1 and n > 1 then len - {front}::double
    else {front}::double + pose_idx::double * ((len - {front}::double - {front}::double) / greatest(n - 1, 1)) end) / {_G}) as px, cy + offset_m / {_G} as py from spot),
body as (select *, round_even(px - {front}::double / {_G}, 0)::int as bx0, round_even(px + {front}::double / {_G}, 0)::int as bx1,
    round_even(py - {side}::double / {_G}, 0)::int as by0, round_even(py + {side}::double / {_G}, 0)::int as by1,
    px - {front}::double / {_G} < 0 or px + {front}::double / {_G} > (select max(x) from lay) or py - {side}::double / {_G} < 0 or py + {side}::double / {_G} > (select max(y) from lay) as oob from pose),
met as (select b.aisle_id, b.label, b.offset_m, b.pose_idx, b.px, b.oob, coalesce(bool_or(l.base = 0), false) as hit, coalesce(bool_or(l.base = 205), false) as unk,
    coalesce(bool_or(l.is_candidate), false) as cand, min(sqrt(d.d2::double) * {_G}) as near from body b
  left join lay l on l.x between b.bx0 and b.bx1 and l.y between b.by0 and b.by1 left join dist d on d.x = l.x and d.y = l.y group by all),
judged as (select *, case when oob then 'out_of_bounds' when hit then 'occupied' when unk then 'unknown' end as reason from met),
routes as (select aisle_id, label, offset_m, count(*)::bigint as pose_count, count(reason)::bigint as blocking_pose_count, count_if(hit)::bigint as collision_pose_count,
    count_if(unk)::bigint as unknown_overlap_pose_count, count_if(cand)::bigint as candidate_overlap_pose_count, count_if(oob)::bigint as out_of_bounds_pose_count,
    min(near) as min_blocked_clearance_m, quantile_cont(near, 0.1) as clearance_p10_m, avg(near) as mean_clearance_m, count(reason) = 0 as passed,
    arg_min(reason, pose_idx) filter (where reason is not null) as first_failure_reason, arg_min(px, pose_idx) filter (where reason is not null) as first_failure_x from judged group by all)"""


_ROUTE_MAP = f"{_grid(t.SPARSE_LABEL)}, {_distance('base <> 254')}, {_axis_lengths()}"
_CENTRE = f"with {_ROUTE_MAP}, {_sweep('select aisle_id, 0.0::double as offset_m from frame')}"
_EVERY = f"with {_ROUTE_MAP}, {_offsets()}, {_sweep('select aisle_id, offset_m from offs')}"
_COUNTS = "pose_count, blocking_pose_count, collision_pose_count, unknown_overlap_pose_count, candidate_overlap_pose_count, out_of_bounds_pose_count"


def _connectivity() -> str:
    radii = ", ".join(f"{r}::double" for r in RADII)
    return f"""with recursive {_grid(t.SPARSE_LABEL)}, {_distance('base <> 254')},
safe as (select a.aisle_id, l.x, l.y, r.radius from lay l join dist d using (x, y) join (select unnest([{radii}]) as radius) r on sqrt(d.d2::double) * {_G} + 1e-12::double >= r.radius
  join aisle a on l.x between {t.AISLE_X0} and {t.AISLE_X1} and l.y between a.y0 and a.y1 where l.base = 254),
ends as (select *, round_even({t.AISLE_X0} + 0.1::double * {t.AISLE_X1 - t.AISLE_X0}, 0)::int as sx, round_even({t.AISLE_X1} - 0.1::double * {t.AISLE_X1 - t.AISLE_X0}, 0)::int as ex,
  round_even((y0 + y1) / 2.0::double, 0)::int as my from aisle),
walk(aisle_id, radius, x, y) as (select s.aisle_id, s.radius, s.x, s.y from safe s join ends e on e.aisle_id = s.aisle_id and s.x = e.sx and s.y = e.my
  union select s.aisle_id, s.radius, s.x, s.y from walk w join safe s on s.aisle_id = w.aisle_id and s.radius = w.radius and abs(s.x - w.x) + abs(s.y - w.y) = 1),
conn as (select e.aisle_id, e.label, r.radius, exists (select 1 from walk w where w.aisle_id = e.aisle_id and w.radius = r.radius and w.x = e.ex and w.y = e.my) as passed
  from ends e, (select unnest([{radii}]) as radius) r)"""


_MID = "(y0 + y1) / 2.0::double"
_DIRECTION = "0.5::double * atan2(2.0::double * covar_pop(x::double, y::double), var_pop(x::double) - var_pop(y::double))"

ORACLES: dict[str, str] = {
    "height_threshold_one_sided": _ground(f"z < {_P10} + 0.15::double"),
    "height_threshold_two_sided": _ground(f"abs(z - {_P10}) < 0.15::double"),
    "height_histogram": f"with {_POINTS}{_histogram(40)} select bin::int as bin, round(left_edge, 6) as left_edge, n from hist",
    "histogram_mode_segment": _ground(f"z < {_MODE} + 0.05::double", _histogram(40)),
    "bounding_box": f"with {_POINTS} select min(x) min_x, max(x) max_x, min(y) min_y, max(y) max_y from pts",
    "height_grid_min": f"with {_CELLS} select x, y, min(z) as h from binned group by x, y",
    "height_grid_max": f"with {_CELLS} select x, y, round(max(z)::float::double, 6) as h from binned group by x, y",
    "relative_height": f"with {_CELLS}, {_relative(5)} select x, y, h, ground, round(h - ground, 6) as rel from rel",
    "traversability": f"with {_CELLS}, {_relative(4)} select x, y, {_TRAV} as trav from rel",
    "traversability_counts": f"with {_CELLS}, {_relative(4)} select {_TRAV} as trav, count(*)::bigint as cells from rel group by 1",
    "ground_traversability_counts": _ground_counts(),
    "row_direction": f"with {_MASK}, a as (select {_DIRECTION} as angle_rad from m) select round(angle_rad, 6) as angle_rad, round(cos(angle_rad), 6) as dx, round(sin(angle_rad), 6) as dy from a",
    "connected_regions": f"with recursive {_MASK}, {_regions('true', 5)} select x, y, component, size from kept",
    "corridor_cells": f"""with recursive {_MASK}, {_regions('true', 8)}, a as (select {_DIRECTION} as a from m), b as (select {_DIRECTION} as b from kept)
select x, y from kept, a, b where abs(cos(b) * cos(a) + sin(b) * sin(a)) >= 0.7::double""",
    "navigation_layers": f"with {_grid(t.LABEL)} select x, y, base, is_candidate, is_aisle, is_hard from lay",
    "layer_counts": f"""with {_grid(t.LABEL)}, c as (select count_if(is_candidate)::bigint as candidate_cell_count, count_if(is_hard)::bigint as hard_obstacle_cell_count,
  count_if(is_hard and base = 254)::bigint as hard_obstacle_as_free_cell_count, count_if(is_pillar)::bigint as pillar_cell_count, count_if(is_pillar and base = 254)::bigint as pillar_as_free_cell_count,
  count_if(base = 254)::bigint as free_cell_count, count_if(base = 205)::bigint as unknown_cell_count, count_if(base = 0)::bigint as occupied_cell_count from lay)
select *, hard_obstacle_as_free_cell_count = 0 as static_obstacle_semantics_valid from c""",
    "gray_semantics": f"""with {_grid(t.LABEL)}, v as (select distinct case when x = 0 and y = 0 then 127 else base end as b from lay)
select string_agg(b::varchar, ',' order by b) as observed_gray_values, coalesce(string_agg(b::varchar, ',' order by b) filter (where b not in (0, 205, 254)), '') as unexpected_gray_values,
  count_if(b not in (0, 205, 254)) = 0 as gray_semantics_valid from v""",
    "clearance_distance": f"with {_grid(t.LABEL)}, {_distance('base <> 254')} select x, y, d2 from dist",
    "clearance_connectivity": f"{_connectivity()} select aisle_id, label, radius, passed from conn",
    "clearance_summary": f"""{_connectivity()} select printf('%.2f', radius) as key, radius as radius_m, 2.0::double * radius as diameter_m, count_if(passed)::bigint as pass_count,
  count(*)::bigint as total_aisles from conn group by radius""",
    "aisle_geometry": f"""with {_grid(t.LABEL)}, {_axis_lengths()} select aisle_id, label, round(len, 6) as length_m, round(wid, 6) as width_m, 0.0::double as yaw,
  round({t.AISLE_X0} + 0.1::double * {t.AISLE_X1 - t.AISLE_X0}, 6) as probe_x, round({_MID}, 6) as probe_y, round({t.AISLE_X1} - 0.1::double * {t.AISLE_X1 - t.AISLE_X0}, 6) as other_x, round({_MID}, 6) as other_y,
  round({t.AISLE_X0} + {_F["front"]}::double / {_G}, 6) as start_x, round({_MID} + 0.05::double / {_G}, 6) as start_y,
  round({t.AISLE_X1} - {_F["front"]}::double / {_G}, 6) as end_x, round({_MID} + 0.05::double / {_G}, 6) as end_y from frame""",
    "footprint_validation": f"""{_CENTRE} select aisle_id, label, pose_count, passed, collision_pose_count, unknown_overlap_pose_count, candidate_overlap_pose_count, out_of_bounds_pose_count,
  first_failure_reason, round(min_blocked_clearance_m, 6) as min_blocked_clearance_m, round(first_failure_x, 6) as first_failure_x from routes""",
    "footprint_summary": f"""{_CENTRE} select count_if(passed)::bigint as pass_count, count_if(not passed)::bigint as fail_count, count(*)::bigint as total_aisles,
  coalesce(string_agg(label, ',' order by aisle_id) filter (where not passed), '') as failed_aisles from routes""",
    "offset_candidates": f"with {_grid(t.LABEL)}, {_axis_lengths()}, {_offsets()} select aisle_id, k, round(offset_m, 6) as offset_m from offs",
    "offset_routes": f"""{_EVERY} select aisle_id, passed, {_COUNTS}, first_failure_reason, round(offset_m, 6) as offset_m, round(min_blocked_clearance_m, 6) as min_blocked_clearance_m,
  round(clearance_p10_m, 6) as clearance_p10_m, round(mean_clearance_m, 6) as mean_clearance_m from routes""",
    "offset_search": f"""{_EVERY}, r as (select *, row_number() over (partition by aisle_id order by abs(offset_m), offset_m) as c,
  row_number() over (partition by aisle_id order by passed desc, -clearance_p10_m, -min_blocked_clearance_m, candidate_overlap_pose_count, abs(offset_m), offset_m) as b,
  row_number() over (partition by aisle_id order by blocking_pose_count, collision_pose_count, unknown_overlap_pose_count, out_of_bounds_pose_count, -clearance_p10_m, -min_blocked_clearance_m,
    candidate_overlap_pose_count, abs(offset_m), offset_m) as a from routes),
f as (select aisle_id, label, count(*)::bigint as tested_offset_count, count_if(passed)::bigint as feasible_offset_count, round(min(offset_m), 6) as offset_min_m, round(max(offset_m), 6) as offset_max_m,
  bool_or(passed) filter (where c = 1) as centerline_passed, bool_or(passed) as passed from r group by aisle_id, label)
select f.*, f.passed and not centerline_passed as route_recovered, case when f.passed then round(b.offset_m, 6) end as best_offset_m,
  case when f.passed then round(b.clearance_p10_m, 6) end as best_clearance_p10_m, case when f.passed then round(b.min_blocked_clearance_m, 6) end as best_min_blocked_clearance_m,
  case when f.passed then b.candidate_overlap_pose_count end as best_candidate_overlap_pose_count, round(a.offset_m, 6) as best_attempt_offset_m,
  a.blocking_pose_count as best_attempt_blocking_pose_count, a.collision_pose_count as best_attempt_collision_pose_count, a.unknown_overlap_pose_count as best_attempt_unknown_pose_count
from f join r b on b.aisle_id = f.aisle_id and b.b = 1 join r a on a.aisle_id = f.aisle_id and a.a = 1""",
}
