"""Smooth routes: lateral offsets that change gradually along an aisle, by dynamic programming over a lattice.

Stations divide the aisle's axis; a transition between neighbouring stations moves the footprint from one offset to
another and is feasible if the hull that it sweeps meets nothing blocked. The table of transitions is built and
measured in parallel over all aisles; the program over it runs once per aisle, whose lattice is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.geometry import Axis, leaves_grid, placed
from furrow.functions.numbers import largest_step, linspace
from furrow.operators.overlap import overlap
from furrow.operators.sweep import OFFSET_STEP_M, SAMPLE_SPACING_M, Footprint, Map, check, distances_along, evaluate, offsets_across, span_m
from furrow.storage import materialise, spread

#: Distance between control points, and how much the offset may change between two.
CONTROL_SPACING_M, MAX_OFFSET_CHANGE_M = 0.50, 0.10
#: Fixed weights of the route's cost.
CLEARANCE, OFFSET, CHANGE, BEND, CANDIDATES = 0.25, 0.20, 1.50, 4.00, 0.005
AXIS = [f"axis_{n}" for n in ("x0", "y0", "x1", "y1", "cells", "ux", "uy", "width")]


def lattice(
    aisles: DataFrame, footprint: Footprint, resolution: float, control_spacing_m: float = CONTROL_SPACING_M, offset_step_m: float = OFFSET_STEP_M,
    endpoint_trim_m: float = 0.0,
) -> DataFrame:
    """aisles with ``offsets`` and ``stations`` (distances of the control points; none if the footprint is too long)."""
    points = check(footprint, control_spacing_m=control_spacing_m)
    if endpoint_trim_m < 0:
        raise ValueError("endpoint_trim_m must not be negative")
    frames = offsets_across(aisles, points, resolution, offset_step_m)
    return frames.withColumn("stations", distances_along(F.col("length_along_m"), points, control_spacing_m, 2, endpoint_trim_m))


def transitions(frames: DataFrame, max_offset_change_m: float = MAX_OFFSET_CHANGE_M) -> DataFrame:
    """(aisle_id, input_ord, axis_…, axis_yaw, stage, i, j, d0, d1, o0, o1, heading) of all offset changes within the limit.

    Stations at one place (an aisle just as long as the footprint) leave no transition.
    """
    if max_offset_change_m < 0:
        raise ValueError("max_offset_change_m must not be negative")
    ends = spread(frames, "aisle_id").where(F.size("stations") >= 2).select(
        "aisle_id", "input_ord", *AXIS, F.col("yaw").alias("axis_yaw"), "offsets",
        F.posexplode(F.zip_with(F.slice("stations", 1, F.size("stations") - 1), F.slice("stations", 2, F.size("stations") - 1), lambda a, b: F.struct(a.alias("d0"), b.alias("d1")))).alias("stage", "d"),
    )
    first = ends.select("*", F.posexplode("offsets").alias("i", "o0"))
    near = F.filter(F.transform("offsets", lambda o, k: F.struct(k.alias("j"), o.alias("o1"))), lambda t: F.abs(t["o1"] - F.col("o0")) <= max_offset_change_m + 1e-12)
    both = first.select("*", F.explode(near).alias("t")).select("aisle_id", "input_ord", *AXIS, "axis_yaw", "stage", "i", "t.j", "d.d0", "d.d1", "o0", "t.o1")
    return both.where("d1 > d0").withColumn("heading", F.atan2(F.col("o1") - F.col("o0"), F.col("d1") - F.col("d0")))


def measured(moves: DataFrame, footprint: Footprint, on: Map, move_m: float) -> DataFrame:
    """(aisle_id, input_ord, stage, i, j, o0, o1, passed, candidates, p10): what each transition's swept hull meets.

    No transition is longer than ``move_m``.
    """
    points = check(footprint)
    axis = Axis.columns()
    ends = {f"_{n}{k}": v for k in (0, 1) for n, v in zip("xy", axis.at(F.col(f"d{k}"), F.col(f"o{k}"), on.resolution), strict=True)}
    moves = moves.withColumns(ends).withColumn("_yaw", F.col("axis_yaw") + F.col("heading"))
    bodies = [placed(points, F.col(f"_x{k}"), F.col(f"_y{k}"), F.col("_yaw"), on.resolution) for k in (0, 1)]
    swept = moves.select("aisle_id", "input_ord", "stage", "i", "j", "o0", "o1", F.concat(*bodies).alias("_all"))
    swept = swept.withColumn("_leaves", leaves_grid(F.col("_all"), F.lit(on.width), F.lit(on.height)))
    seen = overlap(swept, "_all", on.grid, (span_m(points) + move_m) / on.resolution, convex=True)
    stops = F.col("occupied") if on.allow_unknown else F.col("occupied") + F.col("unknown")
    seen = seen.withColumn("passed", ~F.col("_leaves") & (F.col("cells") > 0) & (stops == 0))
    return seen.select("aisle_id", "input_ord", "stage", "i", "j", "o0", "o1", "passed", "candidates", F.col("p10_m").alias("p10"))


def _near(p10: float | None, resolution: float) -> float:
    """The cost of passing close to what blocks; nothing if nothing does."""
    return 0.0 if p10 is None else CLEARANCE / max(p10, resolution)


def cheapest(moves: dict[int, list[tuple[int, int, float, float, int]]], stations: int, resolution: float) -> tuple[list[int] | None, int]:
    """(offset indices of the cheapest route, last station reached) over feasible moves {stage: [(i, j, change, p10,
    candidates)]} with offsets' magnitudes in ``moves[-1]``.

    A state is a pair of neighbouring offsets, as the cost of a bend needs the change before. Of equal costs the state
    reached first stays, where states count in the order in which they were first reached.
    """
    size = {k: v for k, _, v, _, _ in moves.get(-1, [])}
    states: dict[tuple[int, int], tuple[float, float, tuple]] = {}
    for i, j, change, p10, candidates in sorted(moves.get(0, [])):
        own = _near(p10, resolution) + OFFSET * (size[i] + size[j]) + CHANGE * abs(change) + CANDIDATES * candidates
        states[i, j] = (own, change, (j, (i, None)))
    if not states:
        return None, 0
    for stage in range(1, stations - 1):
        after: dict[int, list] = {}
        for move in sorted(moves.get(stage, [])):
            after.setdefault(move[0], []).append(move)
        reached: dict[tuple[int, int], tuple[float, float, tuple]] = {}
        for (_, j), (spent, before, path) in states.items():
            for _, k, change, p10, candidates in after.get(j, ()):
                total = spent + _near(p10, resolution) + OFFSET * size[k] + CHANGE * abs(change) + BEND * abs(change - before) + CANDIDATES * candidates
                known = reached.get((j, k))
                if known is None or total < known[0]:
                    reached[j, k] = (total, change, (k, path))
        if not reached:
            return None, stage
        states = reached
    link, route = min(states.values(), key=lambda s: s[0])[2], []
    while link:
        route.append(link[0])
        link = link[1]
    return route[::-1], stations - 1


def plan(frames: DataFrame, edges: DataFrame, resolution: float) -> DataFrame:
    """(aisle_id, control_offsets_m, failure_reason, failure_region): the program's result for every aisle."""
    rows = frames.select("aisle_id", "input_ord", "offsets", F.size("stations").alias("stations"))
    feasible = edges.where("passed").groupBy("aisle_id", "input_ord").agg(F.collect_list(F.struct("stage", "i", "j", (F.col("o1") - F.col("o0")).alias("change"), "p10", "candidates")).alias("moves"))
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = rows.join(feasible, ["aisle_id", "input_ord"], "left").repartition(parts, "aisle_id")  # one program an aisle, not all in one task

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                offsets = list(row.offsets)
                path, reason, region = None, None, None
                if not offsets:
                    reason, region = "footprint_wider_than_aisle", "aisle_geometry"
                elif row.stations < 2:
                    reason, region = "footprint_longer_than_aisle", "aisle_geometry"
                else:
                    moves: dict[int, list] = {-1: [(k, 0, abs(o), 0.0, 0) for k, o in enumerate(offsets)]}
                    for m in row.moves if row.moves is not None else ():
                        moves.setdefault(m["stage"], []).append((m["i"], m["j"], m["change"], m["p10"], m["candidates"]))
                    path, at = cheapest(moves, row.stations, resolution)
                    if path is None:
                        reason = f"no_feasible_transition_at_station_{at + 1}" if at else "no_feasible_first_transition"
                        region = "entry" if not at else "exit" if at + 1 == row.stations - 1 else "interior"
                out.append((row.aisle_id, row.input_ord, [float(offsets[k]) for k in path or []], reason, region))
            yield pd.DataFrame(out, columns=["aisle_id", "input_ord", "control_offsets_m", "failure_reason", "failure_region"])

    return joined.mapInPandas(run, "aisle_id int, input_ord int, control_offsets_m array<double>, failure_reason string, failure_region string")


def sampled(frames: DataFrame, planned: DataFrame, footprint: Footprint, on: Map, sample_spacing_m: float) -> DataFrame:
    """(aisle_id, stage, pose_idx, distance_m, offset_m, heading, …): the evaluated poses along the planned routes.

    A transition's last pose and the next one's first lie at one place and are both evaluated.
    """
    routes = frames.join(planned.where(F.size("control_offsets_m") > 0), ["aisle_id", "input_ord"])
    n = F.size("stations") - 1
    legs = F.zip_with(F.slice("stations", 1, n), F.slice("stations", 2, n), lambda a, b: F.struct(a.alias("d0"), b.alias("d1")))
    sides = F.zip_with(F.slice("control_offsets_m", 1, n), F.slice("control_offsets_m", 2, n), lambda a, b: F.struct(a.alias("o0"), b.alias("o1")))
    legs = spread(routes, "aisle_id").select("aisle_id", "input_ord", *AXIS, F.col("yaw").alias("axis_yaw"), F.posexplode(F.arrays_zip(legs.alias("leg"), sides.alias("side"))).alias("stage", "e"))
    legs = legs.select("*", "e.leg.d0", "e.leg.d1", "e.side.o0", "e.side.o1")
    ds = F.col("d1") - F.col("d0")
    count = F.greatest(F.lit(2), F.ceil(ds / sample_spacing_m) + 1)
    at = F.arrays_zip(linspace(F.col("d0"), F.col("d1"), count).alias("d"), linspace(F.col("o0"), F.col("o1"), count).alias("o"))
    poses = legs.withColumn("heading", F.atan2(F.col("o1") - F.col("o0"), ds)).select("*", F.posexplode(at).alias("pose_idx", "p"))
    poses = poses.withColumn("distance_m", F.col("p")["d"]).withColumn("offset_m", F.col("p")["o"]).withColumn("yaw", F.col("axis_yaw") + F.col("heading"))
    x, y = Axis.columns().at(F.col("distance_m"), F.col("offset_m"), on.resolution)
    keys = ["aisle_id", "input_ord", "stage", "pose_idx", "distance_m", "offset_m", "heading"]
    return evaluate(poses.select(*keys, x.alias("x"), y.alias("y"), "yaw"), keys, footprint, on)


def _route(poses: DataFrame) -> DataFrame:
    """One row per planned route: counts over all transitions, clearances over the route's distinct poses."""
    own = (F.col("stage") == 0) | (F.col("pose_idx") > 0)
    spot = F.struct("stage", "pose_idx", "distance_m", "offset_m", F.col("x").alias("x_cell"), F.col("y").alias("y_cell"), F.col("yaw").alias("yaw_rad"), "clearance_m")
    fields = ("distance_m", "offset_m", "x_cell", "y_cell", "yaw_rad", "clearance_m")
    return poses.groupBy("aisle_id", "input_ord").agg(
        F.count_if("blocking").alias("blocking_pose_count"),
        F.count_if("collision").alias("collision_pose_count"),
        F.count_if("unknown").alias("unknown_overlap_pose_count"),
        F.count_if("candidate").alias("candidate_overlap_pose_count"),
        F.count_if("out_of_bounds").alias("out_of_bounds_pose_count"),
        F.min(F.when(own, F.col("clearance_m"))).alias("min_blocked_clearance_m"),
        F.percentile(F.when(own, F.col("clearance_m")), 0.1).alias("clearance_p10_m"),
        F.max(F.abs("heading")).alias("max_heading_deviation_rad"),
        F.transform(F.array_sort(F.collect_list(F.when(own, spot))), lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("route_points"),
    )


def search_smooth_routes(
    aisles: DataFrame, footprint: Footprint, on: Map, sample_spacing_m: float = SAMPLE_SPACING_M, control_spacing_m: float = CONTROL_SPACING_M,
    offset_step_m: float = OFFSET_STEP_M, max_offset_change_m: float = MAX_OFFSET_CHANGE_M, endpoint_trim_m: float = 0.0, baseline: DataFrame | None = None,
) -> DataFrame:
    """One row per aisle: the smooth route and its metrics, or why and where there is none.

    ``baseline`` (label, passed, and optionally an input order ``ord``) holds earlier results; of several for a label
    the last counts. ``passed`` follows the lattice alone; ``sampled_passed`` also asks that no sampled pose is
    blocked.
    """
    points = check(footprint, sample_spacing_m=sample_spacing_m)
    frames = materialise(lattice(aisles, points, on.resolution, control_spacing_m, offset_step_m, endpoint_trim_m), "lattice")
    moves = measured(transitions(frames, max_offset_change_m), points, on, control_spacing_m + max_offset_change_m)
    planned = materialise(plan(frames, moves, on.resolution), "planned")
    routes = _route(sampled(frames, planned, points, on, sample_spacing_m))
    out = frames.join(planned, ["aisle_id", "input_ord"]).join(routes, ["aisle_id", "input_ord"], "left")
    if baseline is None:
        out = out.withColumns({"b1_passed": F.lit(None).cast("boolean"), "baseline_b1_available": F.lit(False)})
    else:
        order = F.col("ord") if "ord" in baseline.columns else F.monotonically_increasing_id()
        last = baseline.withColumn("_o", order).groupBy("label").agg(F.max_by(F.coalesce("passed", F.lit(False)), "_o").alias("b1_passed"))
        out = out.join(last.withColumn("_has", F.lit(True)), "label", "left").withColumn("baseline_b1_available", F.coalesce("_has", F.lit(False)))
    counts = ["blocking_pose_count", "collision_pose_count", "unknown_overlap_pose_count", "candidate_overlap_pose_count", "out_of_bounds_pose_count"]
    passed = F.col("failure_reason").isNull()
    out = out.fillna(0, counts)
    none: Column = F.array().cast("array<struct<distance_m:double,offset_m:double,x_cell:double,y_cell:double,yaw_rad:double,clearance_m:double>>")
    return out.select(
        "input_ord", "aisle_id", "label", F.coalesce("width_m", "width_across_m").alias("width_m"), F.coalesce("length_m", "length_along_m").alias("length_m"),
        passed.alias("passed"), "b1_passed", "baseline_b1_available",
        (passed & F.col("baseline_b1_available") & ~F.coalesce("b1_passed", F.lit(True))).alias("route_recovered_from_b1"),
        F.size("stations").alias("control_point_count"), F.size("offsets").alias("tested_offset_count"), "control_offsets_m",
        F.coalesce("route_points", none).alias("route_points"), *counts, "min_blocked_clearance_m", "clearance_p10_m",
        F.when(passed, largest_step(F.col("control_offsets_m"))).alias("max_offset_step_m"), "max_heading_deviation_rad",
        "failure_reason", "failure_region", (passed & (F.col("blocking_pose_count") == 0)).alias("sampled_passed"),
    )

