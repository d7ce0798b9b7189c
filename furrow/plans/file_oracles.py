"""DuckDB SQL for the queries through files and for routes on oblique or smooth paths; adds to ``ORACLES``."""

from __future__ import annotations

from furrow.plans import route_oracles as r
from furrow.plans import tables as t
from furrow.plans.oracles import _CELLS, _DIRECTION, _MASK, _P10, _POINTS, ORACLES, _connectivity, _grid, _ground, _regions
from furrow.sinks.files import FOOTPRINT_COLUMNS, OFFSET_COLUMNS, SMOOTH_COLUMNS

_FRONT, _REAR = max(x for x, _ in t.FOOTPRINT), -min(x for x, _ in t.FOOTPRINT)


def _dense(columns: dict[str, str], table: str) -> str:
    """Every cell from (0, 0) to the greatest x and y of ``table``; absent ones hold the default."""
    filled = ", ".join(f"coalesce({c}, {v}) as {c}" for c, v in columns.items())
    return f"""across as (select unnest(range(0, (select max(x) from {table}) + 1))::int as x), up as (select unnest(range(0, (select max(y) from {table}) + 1))::int as y)
select x, y, {filled} from across cross join up left join {table} using (x, y)"""


def _flag(column: str) -> str:
    return f"case when {column} then 'True' when not {column} then 'False' else '' end as {column.split('.')[-1]}"


def _text(columns: tuple[str, ...], flags: tuple[str, ...], numbers: dict[str, str] | None = None) -> str:
    """A CSV's columns: flags and all others as text, lengths and angles as rounded numbers."""
    numbers = numbers or {}
    out = []
    for c in columns:
        if c in numbers:
            out.append(f"{numbers[c]} as {c}")
        elif c in flags:
            out.append(_flag(c))
        elif c.endswith(("_m", "_rad")):
            out.append(f"round({c}, 6) as {c}")
        else:
            out.append(f"coalesce({c}::varchar, '') as {c}")
    return ", ".join(out)


_COUNTS = "pose_count, blocking_pose_count, collision_pose_count, unknown_overlap_pose_count, candidate_overlap_pose_count, out_of_bounds_pose_count"
_CHECKED = f"""select aisle_id, label, pose_count, passed, collision_pose_count, unknown_overlap_pose_count, candidate_overlap_pose_count, out_of_bounds_pose_count,
  first_failure_reason, round(min_blocked_clearance_m, 6) as min_blocked_clearance_m, round(first_failure_x, 6) as first_failure_x from routes"""
_CENTRE = "select aisle_id, 0.0::double as offset_m from frame"
_SEARCH = f"""with {r.LANES}, ranked as (select *, row_number() over (partition by aisle_id order by abs(offset_m), offset_m) as c,
  row_number() over (partition by aisle_id order by passed desc, -clearance_p10_m, -min_blocked_clearance_m, candidate_overlap_pose_count, abs(offset_m), offset_m) as b,
  row_number() over (partition by aisle_id order by blocking_pose_count, collision_pose_count, unknown_overlap_pose_count, out_of_bounds_pose_count, -clearance_p10_m, -min_blocked_clearance_m,
    candidate_overlap_pose_count, abs(offset_m), offset_m) as a from routes),
found as (select aisle_id, label, count(*)::bigint as tested_offset_count, count_if(passed)::bigint as feasible_offset_count, bool_or(passed) filter (where c = 1) as centerline_passed, bool_or(passed) as passed
  from ranked group by aisle_id, label),
search as (select f.*, w.wid as width_m, w.len as length_m, f.passed and not f.centerline_passed as route_recovered, case when f.passed then b.offset_m end as best_offset_m,
  case when f.passed then b.min_blocked_clearance_m end as best_min_blocked_clearance_m, case when f.passed then b.clearance_p10_m end as best_clearance_p10_m,
  case when f.passed then b.candidate_overlap_pose_count end as best_candidate_overlap_pose_count, a.offset_m as best_attempt_offset_m, a.blocking_pose_count as best_attempt_blocking_pose_count,
  a.collision_pose_count as best_attempt_collision_pose_count, a.unknown_overlap_pose_count as best_attempt_unknown_pose_count
  from found f join frame w using (aisle_id) join ranked b on b.aisle_id = f.aisle_id and b.b = 1 join ranked a on a.aisle_id = f.aisle_id and a.a = 1)"""
_FAILED = "case when not passed then label end"
_NOTCHED_MAP = f"{r.grid(r.OBLIQUE)}, {r.constant_routes(_CENTRE, t.NOTCHED, clip=True)}"
_SMOOTH_CSV = ("passed", "b1_passed", "baseline_b1_available", "route_recovered_from_b1")
_SMOOTH_ROWS = r.SMOOTH_ROWS.format("b.b1 as b1_passed, true as baseline_b1_available, r.passed and not b.b1 as route_recovered_from_b1,") + f" join {r.BASELINE} b using (aisle_id)"
_IMAGE = "round({0})::int as x{1}, round((select max(y) from lay) - {2})::int as y{1}"


def _line(kind: str, offset: str) -> str:
    def at(d: str, k: int) -> str:
        return _IMAGE.format(f"(sx + ux * (({d}) / {r.RES}) - uy * ({offset} / {r.RES}))", k, f"(sy + uy * (({d}) / {r.RES}) + ux * ({offset} / {r.RES}))")

    return f"select f.label, {kind} as kind, {at(f'{_REAR}::double', 0)}, {at(f'len - {_FRONT}::double', 1)} from frame f join search s using (aisle_id)"


_REFUSED = {
    "two vertices": True, "no spacing": True, "negative step": True, "no resolution": True, "no axis": True, "three corners": True, "negative change": True, "negative trim": True, "good": False,
    "yaml: good": False, "yaml: mode": True, "yaml: thresholds": True, "yaml: range": True,
}
_PAGE = (
    "<!doctype html><meta charset=utf-8><title>Maps &amp; routes</title><h1>Maps &amp; routes</h1>"
    '<section><h2>height&lt;1&gt;</h2><img src="height&lt;1&gt;.png" alt=""></section><section><h2>c</h2><img src="b/c.png" alt=""></section>'
)
_GEOMETRY = f"""select aisle_id, label, round(len, 6) as length_m, round(wid, 6) as width_m, round(yaw, 6) as yaw, round(sx + 0.1::double * dx, 6) as probe_x, round(sy + 0.1::double * dy, 6) as probe_y,
  round(sx + dx - 0.1::double * dx, 6) as other_x, round(sy + dy - 0.1::double * dy, 6) as other_y,
  {', '.join(f"round(sx + ux * (({d}) / {r.RES}) - uy * (0.05::double / {r.RES}), 6) as {n}_x, round(sy + uy * (({d}) / {r.RES}) + ux * (0.05::double / {r.RES}), 6) as {n}_y" for n, d in (("start", f"{_REAR}::double"), ("end", f"len - {_FRONT}::double")))}
  from frame"""

ORACLES |= {
    "point_cloud_file": f"with {_POINTS} select round(x::float::double, 6) as x, round(y::float::double, 6) as y, round(z::float::double, 6) as z, count(*)::bigint as n from pts group by all",
    "label_file": f"with semantic as (select {t.CELL['x']} as x, {t.CELL['y']} as y, {t.LABEL} as label from orders), {_dense({'label': '0'}, 'semantic')}",
    "map_image": f"with {_grid(t.LABEL)}, {_dense({'base': '205'}, 'lay')}",
    "bundle_masks": f"with {_grid(t.SPARSE_LABEL)}, {_dense({'is_candidate': 'false', 'is_hard': 'false', 'base': '205'}, 'lay')}",
    "bundle_validation": f"""{_connectivity()}, p as (select count_if(passed)::bigint as n, count(distinct aisle_id)::int as aisles, arg_min(label, aisle_id) as first_label from conn)
select count_if(is_candidate)::bigint as candidate_cell_count, count_if(is_hard)::bigint as hard_obstacle_cell_count, count_if(is_hard and base = 254)::bigint as hard_obstacle_as_free_cell_count,
  count_if(is_pillar)::bigint as pillar_cell_count, count_if(is_pillar and base = 254)::bigint as pillar_as_free_cell_count, count_if(base = 254)::bigint as free_cell_count,
  count_if(base = 205)::bigint as unknown_cell_count, count_if(base = 0)::bigint as occupied_cell_count, true as gray_semantics_valid, count_if(is_hard and base = 254) = 0 as static_obstacle_semantics_valid,
  true as map_server_yaml_valid, (select string_agg(base::varchar, ',' order by base) from (select distinct base from lay)) as observed_gray_values, {r.RES} as resolution_m, any_value(p.aisles) as aisles,
  any_value(p.n) as passed_tests, any_value(p.n) as passed_by_aisle, any_value(p.first_label) as first_label, 'navigation_base_map.pgm' as image, 'trinary' as mode, {r.RES} as resolution,
  0.65::double as occupied_thresh, 0.196::double as free_thresh from lay, p""",
    "aisle_file": f"""with semantic as (select {t.CELL['y']} as y from orders), a as ({r.STRIPS}), n as (select *, (row_number() over (order by aisle_id) - 1)::int as input_ord from a),
c as (select *, unnest([0, 1, 2, 3]) as k from n)
select form, aisle_id, '' as label, 0.4::double as width_m, true as no_length, input_ord, k, px[k + 1] as x, py[k + 1] as y from c, (values ('bare'), ('named')) as v(form)""",
    "footprint_file": f"select * from (values {', '.join(f'({name!r}, {k}, {x}::double, {y}::double)' for name in ('cart', 'robot') for k, (x, y) in enumerate(t.FOOTPRINT))}) as v(name, k, x, y)",
    "footprint_report": f"""with {r.grid(r.STRIPS)}, {r.constant_routes(_CENTRE, t.FOOTPRINT, clip=True)}
select {_text(FOOTPRINT_COLUMNS, ("passed",), {"width_m": "'0.0'", "length_m": "'0.0'"})} from routes""",
    "offset_report": f"{_SEARCH} select {_text(OFFSET_COLUMNS, ('centerline_passed', 'passed', 'route_recovered'))} from search",
    "offset_summary": f"""{_SEARCH} select count_if(passed)::bigint as pass_count, count_if(not passed)::bigint as fail_count, count(*)::bigint as total_aisles,
  coalesce(string_agg({_FAILED}, ',' order by aisle_id), '') as failed_aisles, count_if(route_recovered)::bigint as recovered_route_count,
  coalesce(string_agg(case when route_recovered then label end, ',' order by aisle_id), '') as recovered_route_aisles, count_if(centerline_passed)::bigint as centerline_pass_count from search""",
    "baseline_file": f"""{_SEARCH} select (row_number() over (order by aisle_id) - 1)::int as ord, label, passed, round(best_offset_m, 6) as best_offset_m, round(best_attempt_offset_m, 6) as best_attempt_offset_m from search""",
    "smooth_report": f"{r.SMOOTH} select {_text(SMOOTH_COLUMNS, _SMOOTH_CSV)} from ({_SMOOTH_ROWS})",
    "centreline_file": f"""with recursive {_MASK}, {_regions('true', 8)}, a as (select {_DIRECTION} as a from m), b as (select {_DIRECTION} as b from kept),
c as (select x, y from kept, a, b where abs(cos(b) * cos(a) + sin(b) * sin(a)) >= 0.7::double)
select 0 as line, 'x,y' as text union all select (row_number() over (order by y, x))::int, x || ',' || y from c""",
    "corridor_metadata": f"""with recursive {_MASK}, {_regions('true', 8)}, a as (select {_DIRECTION} as a, count(*)::bigint as points from m), b as (select {_DIRECTION} as b, count(*)::bigint as n from kept)
select 'corridor' as experiment, round(a, 6) as row_angle_rad, round(cos(a), 6) as dx, round(sin(a), 6) as dy, points, case when abs(cos(b) * cos(a) + sin(b) * sin(a)) >= 0.7::double then n else 0 end as corridor_cells from a, b""",
    "report_page": f"select '{_PAGE}' as page",
    "voxel_ground": _ground(f"abs(z - {_P10}) < 0.15::double"),
    "refused_inputs": f"select * from (values {', '.join(f'({k!r}, {str(v).lower()})' for k, v in _REFUSED.items())}) as v(\"case\", refused)",
    "height_plot": f"""with {_CELLS}, cells as (select x, y, max(z)::float as h from binned group by x, y),
across as (select unnest(range(0, (select max(x) from cells) + 1))::int as x), up as (select unnest(range(0, (select max(y) from cells) + 1))::int as y)
select x, y, round(h::double, 6) as value from across cross join up left join cells using (x, y)""",
    "segmented_cloud_plot": f"with {_POINTS} select round(x, 6) as x, round(y, 6) as y, z < {_P10} + 0.15::double as is_ground, count(*)::bigint as n from pts group by all",
    "offset_overlay": f"""{_SEARCH}, drawn as ({_line("'centreline'", "0.0::double")} union all
{_line("case when not s.passed then 'attempt' when route_recovered then 'recovered' else 'route' end", "coalesce(best_offset_m, best_attempt_offset_m)")}),
w as (select list_min(px)::int - 3 as x0, list_max(px)::int + 3 as x1, (select max(y) from lay) - list_max(py)::int - 3 as y0, (select max(y) from lay) - list_min(py)::int + 3 as y1 from aisle where aisle_id = 1)
select drawn.*, (drawn.x0 between w.x0 and w.x1 and drawn.y0 between w.y0 and w.y1) or (drawn.x1 between w.x0 and w.x1 and drawn.y1 between w.y0 and w.y1) as shown from drawn, w""",
    "smooth_overlay": f"""{r.SMOOTH} select f.label, 'route' as kind, (row_number() over (partition by j.aisle_id order by stage, pose_idx) - 1)::int as k, round(j.x)::int as x,
  round((select max(y) from lay) - j.y)::int as y from judged j join frame f using (aisle_id) where stage = 0 or pose_idx > 0""",
    "aisle_outlines": f"""with {r.grid(r.STRIPS)}, c as (select *, unnest(range(6))::int as k from frame)
select aisle_id, k, case k when 4 then sx when 5 then sx + dx else px[k + 1] end as x, case k when 4 then sy when 5 then sy + dy else py[k + 1] end as y from c""",
    "aisle_centres": f"with {r.grid(r.STRIPS)} select aisle_id, round(sx + ux * (1.0::double / {r.RES}) - uy * (0.05::double / {r.RES}), 6) as x, round(sy + uy * (1.0::double / {r.RES}) + ux * (0.05::double / {r.RES}), 6) as y from frame",
    "clearance_report": f"{_connectivity()} select aisle_id, label, printf('%.2f', radius) as key, passed from conn",
    "footprint_validation_unknown_allowed": f"with {r.grid(r.STRIPS, 'base = 0')}, {r.constant_routes(_CENTRE, t.FOOTPRINT, allow_unknown=True, clip=True)} {_CHECKED}",
    "oblique_aisle_cells": f"with {r.grid(r.OBLIQUE)} select id as aisle_id, x, y from lane",
    "oblique_aisle_geometry": f"with {r.grid(r.OBLIQUE)} {_GEOMETRY}",
    "oblique_footprint_validation": f"with {_NOTCHED_MAP} {_CHECKED}",
    "oblique_offset_routes": f"""with {r.grid(r.OBLIQUE)}, {r.offsets()}, {r.constant_routes('select aisle_id, o as offset_m from offs', t.FOOTPRINT)}
select aisle_id, passed, {_COUNTS}, first_failure_reason, round(offset_m, 6) as offset_m, round(min_blocked_clearance_m, 6) as min_blocked_clearance_m,
  round(clearance_p10_m, 6) as clearance_p10_m, round(mean_clearance_m, 6) as mean_clearance_m from routes""",
    "smooth_routes": f"{r.SMOOTH} {_SMOOTH_ROWS}",
    "smooth_route_offsets": " union all ".join(
        f"select {str(lenient).lower()} as allow_unknown, aisle_id, k, round(o, 6) as offset_m from (with recursive {r.grid(r.STRIPS, 'base = 0' if lenient else 'base <> 254')}, {r.offsets()}, {r.smooth(allow_unknown=lenient)} select * from control)"
        for lenient in (False, True)
    ),
    "smooth_failures": f"{r.SMOOTH} select failure_region, failure_reason, string_agg(label, ',' order by aisle_id) as labels from ({r.SMOOTH_ROWS.format('')}) where not passed group by failure_region, failure_reason",
    "smooth_route_points": f"""{r.SMOOTH} select aisle_id, (row_number() over (partition by aisle_id order by stage, pose_idx) - 1)::int as k, round(d, 6) as distance_m, round(o, 6) as offset_m, round(x, 6) as x_cell,
  round(y, 6) as y_cell, round(yaw, 6) as yaw_rad, round(clear, 6) as clearance_m from judged where stage = 0 or pose_idx > 0""",
}
