"""Footprints swept along aisles: poses, what they cover of the map, routes, and the choice among routes.

An aisle is (aisle_id int, label, polygon, width_m, length_m); the map is grid(x, y, base, is_candidate, dist_m).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.geometry import Axis, extents, leaves_grid, placed
from furrow.functions.numbers import clip, distinct_within, linspace, steps_within
from furrow.operators.distance import with_distance
from furrow.operators.layers import blocked, labelled
from furrow.operators.overlap import RESULTS, overlap
from furrow.storage import materialise, spread

Footprint = Sequence[tuple[float, float]]

#: Distance between the poses of a route, and between constant offsets.
SAMPLE_SPACING_M, OFFSET_STEP_M = 0.10, 0.05


def check(footprint: Footprint, **positive: float) -> list[tuple[float, float]]:
    points = [(float(x), float(y)) for x, y in footprint]
    if len(points) < 3:
        raise ValueError("a footprint needs at least three vertices")
    for name, value in positive.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")
    return points


def span_m(footprint: Footprint) -> float:
    """The greatest distance of two vertices."""
    return max(math.dist(p, q) for p, q in combinations(footprint, 2))


@dataclass(frozen=True)
class Map:
    """The map with the distance to what blocks, and its size."""

    grid: DataFrame
    width: int
    height: int
    resolution: float
    allow_unknown: bool

    @classmethod
    def of(cls, cells: DataFrame, resolution: float, allow_unknown: bool = False) -> Map:
        """From cells(x, y, base) and, optionally, is_candidate.

        The distances are computed once and written to the shared folder, as every route reads them; the size is two
        numbers read from what was written.
        """
        if resolution <= 0:
            raise ValueError("resolution must be positive")
        if "is_candidate" not in cells.columns:
            cells = cells.withColumn("is_candidate", F.lit(False))
        marked = cells.select("x", "y", "base", "is_candidate", blocked(F.col("base"), allow_unknown).alias("blocked"))
        grid = materialise(with_distance(marked, resolution).drop("blocked"), "map")
        width, height = (0 if n is None else n + 1 for n in grid.agg(F.max("x"), F.max("y")).first())
        return cls(grid, width, height, resolution, allow_unknown)


def along(aisles: DataFrame, resolution: float) -> DataFrame:
    """aisles with their axis and frame as columns: axis_…, length_along_m, width_across_m, yaw, ``input_ord`` if missing."""
    aisles = spread(labelled(aisles), "aisle_id").withColumns(Axis.of(F.col("polygon")).named())
    if "input_ord" not in aisles.columns:
        aisles = aisles.withColumn("input_ord", F.col("aisle_id"))
    axis = Axis.columns()
    bad = F.raise_error(F.concat(F.lit("aisle without four corners or length: "), F.col("aisle_id").cast("string"))).cast("double")
    length = F.when((F.size("polygon") == 4) & (axis.cells > 0), axis.cells * resolution).otherwise(bad)
    return aisles.withColumns({"length_along_m": length, "width_across_m": axis.width_cells * resolution, "yaw": axis.yaw})


def offsets_across(aisles: DataFrame, footprint: Footprint, resolution: float, offset_step_m: float = OFFSET_STEP_M) -> DataFrame:
    """aisles with ``offsets``: the ascending lateral offsets that keep the footprint inside the aisle's width.

    Multiples of the step, zero and both bounds, without near-equal ones; none if the footprint is too wide.
    """
    points = check(footprint, resolution=resolution, offset_step_m=offset_step_m)
    reach = extents(points)
    half = F.col("width_across_m") / 2.0
    frames = along(aisles, resolution).withColumns({"_low": -half + reach["right"], "_high": half - reach["left"]})
    low, high = F.col("_low"), F.col("_high")
    zero = F.when((low <= 0) & (high >= 0), F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>"))
    values = F.concat(zero, steps_within(offset_step_m, low, high), F.array(low, high))
    kept = distinct_within(F.transform(values, lambda v: clip(v, low, high)))
    return frames.withColumn("offsets", F.when(low > high + 1e-12, F.array().cast("array<double>")).otherwise(kept)).drop("_low", "_high")


def distances_along(length: Column, footprint: Footprint, spacing: float, least: int = 1, trim: float = 0.0) -> Column:
    """Evenly spaced distances that keep the footprint inside the aisle's length, at most ``spacing`` apart; none if
    it is too long."""
    reach = extents(list(footprint))
    rear, front = reach["rear"] + trim, reach["front"] + trim
    usable = length - rear - front
    count = F.greatest(F.lit(least), F.ceil(F.greatest(usable, F.lit(0.0)) / spacing) + 1)
    return F.when(usable < -1e-12, F.array().cast("array<double>")).otherwise(linspace(F.lit(rear), length - front, count))


def evaluate(poses: DataFrame, keys: list[str], footprint: Footprint, on: Map, clip_outside: bool = False) -> DataFrame:
    """poses(keys…, x, y, yaw): one row each with out_of_bounds, collision, unknown, candidate, clearance_m, blocking
    and reason.

    ``clip_outside`` measures the clearance of a pose that leaves the grid by its cells inside, and does not count a
    footprint without any cell inside as out of bounds by itself; otherwise both give clearance 0 and out of bounds.
    """
    body = placed(list(footprint), F.col("x"), F.col("y"), F.col("yaw"), on.resolution)
    marked = poses.select(*keys, "x", "y", "yaw").withColumn("_body", body)
    marked = marked.withColumn("_leaves", leaves_grid(F.col("_body"), F.lit(on.width), F.lit(on.height)))
    seen = overlap(marked, "_body", on.grid, span_m(footprint) / on.resolution, percentile=False)
    seen = seen.withColumns({"collision": F.col("occupied") > 0, "unknown": F.col("unknown") > 0, "candidate": F.col("candidates") > 0})
    outside = F.col("_leaves") if clip_outside else F.col("_leaves") | (F.col("cells") == 0)
    near = F.when(F.col("cells") == 0, F.lit(0.0)).otherwise(F.col("near_m"))  # null if nothing on the map blocks
    seen = seen.withColumns({"out_of_bounds": outside, "clearance_m": near if clip_outside else F.when(outside, F.lit(0.0)).otherwise(near)})
    stops = F.when(F.col("out_of_bounds"), "out_of_bounds").when(F.col("collision"), "occupied")
    if not on.allow_unknown:
        stops = stops.when(F.col("unknown"), "unknown")
    return seen.withColumn("reason", stops).withColumn("blocking", F.col("reason").isNotNull()).drop("_leaves", *RESULTS.keys() - {"unknown"})


def _pose() -> Column:
    return F.struct(F.col("x").alias("x_cell"), F.col("y").alias("y_cell"), F.col("yaw").alias("yaw_rad"))


def route_metrics(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """One row per route: pose counts, clearance least, 10th percentile and mean, and the first failure in pose order."""
    failed = F.when(F.col("blocking"), F.col("pose_idx"))
    return evaluated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pose_count"),
        F.count_if("blocking").alias("blocking_pose_count"),
        F.count_if("collision").alias("collision_pose_count"),
        F.count_if("unknown").alias("unknown_overlap_pose_count"),
        F.count_if("candidate").alias("candidate_overlap_pose_count"),
        F.count_if("out_of_bounds").alias("out_of_bounds_pose_count"),
        F.min("clearance_m").alias("min_blocked_clearance_m"),
        F.percentile("clearance_m", 0.1).alias("clearance_p10_m"),
        F.avg("clearance_m").alias("mean_clearance_m"),
        F.min_by("reason", failed).alias("first_failure_reason"),
        F.min_by(_pose(), failed).alias("first_failure_pose"),
    )


COUNTS = ("pose_count", "blocking_pose_count", "collision_pose_count", "unknown_overlap_pose_count", "candidate_overlap_pose_count", "out_of_bounds_pose_count")
CLEARANCES = ("min_blocked_clearance_m", "clearance_p10_m", "mean_clearance_m")


def _routes(frames: DataFrame, keys: list[str], footprint: Footprint, on: Map, spacing: float, offset: Column, clip_outside: bool) -> DataFrame:
    """frames(keys…, polygon, length_along_m, yaw): metrics of one route each; a too long footprint fails without poses."""
    stops = spread(frames, "aisle_id").withColumn("_offset", offset).select("*", F.posexplode(distances_along(F.col("length_along_m"), footprint, spacing)).alias("pose_idx", "_d"))
    x, y = Axis.columns().at(F.col("_d"), F.col("_offset"), on.resolution)
    metrics = route_metrics(evaluate(stops.select(*keys, "pose_idx", x.alias("x"), y.alias("y"), "yaw"), [*keys, "pose_idx"], footprint, on, clip_outside), keys)
    out = frames.join(metrics, keys, "left")
    out = out.withColumn("first_failure_reason", F.when(F.col("pose_count").isNull(), "footprint_longer_than_aisle").otherwise(F.col("first_failure_reason")))
    out = out.withColumn("passed", (F.col("pose_count") > 0) & (F.col("blocking_pose_count") == 0))
    out = out.withColumns({c: F.when(F.col("pose_count").isNull(), F.lit(0.0)).otherwise(F.col(c)) for c in CLEARANCES})
    return out.fillna(0, list(COUNTS)).fillna(False, ["passed"])


def validate_footprint(aisles: DataFrame, footprint: Footprint, on: Map, sample_spacing_m: float = SAMPLE_SPACING_M) -> DataFrame:
    """Centreline check: one row per aisle, in ``input_ord``."""
    points = check(footprint, sample_spacing_m=sample_spacing_m)
    frames = along(aisles, on.resolution)
    routes = _routes(frames, ["aisle_id", "input_ord"], points, on, sample_spacing_m, F.lit(0.0), True)
    return routes.select(
        "input_ord", "aisle_id", "label", F.coalesce("width_m", F.lit(0.0)).alias("width_m"), F.coalesce("length_m", F.lit(0.0)).alias("length_m"),
        F.col("yaw").alias("heading_rad"), "pose_count", "passed", "collision_pose_count", "unknown_overlap_pose_count", "candidate_overlap_pose_count",
        "out_of_bounds_pose_count", "min_blocked_clearance_m", "first_failure_reason", "first_failure_pose",
    )


def offset_routes(aisles: DataFrame, footprint: Footprint, on: Map, sample_spacing_m: float = SAMPLE_SPACING_M, offset_step_m: float = OFFSET_STEP_M) -> DataFrame:
    """One row per aisle and constant lateral offset: the route's metrics."""
    points = check(footprint, sample_spacing_m=sample_spacing_m)
    return _offset_routes(materialise(offsets_across(aisles, points, on.resolution, offset_step_m), "offsets"), points, on, sample_spacing_m)


def _offset_routes(every: DataFrame, points: Footprint, on: Map, sample_spacing_m: float) -> DataFrame:
    frames = every.withColumn("offset_m", F.explode("offsets"))
    return _routes(frames, ["aisle_id", "input_ord", "offset_m"], points, on, sample_spacing_m, F.col("offset_m"), False)


def search_offsets(aisles: DataFrame, footprint: Footprint, on: Map, sample_spacing_m: float = SAMPLE_SPACING_M, offset_step_m: float = OFFSET_STEP_M) -> DataFrame:
    """One row per aisle: the best passing offset, else the best attempt, and how the centreline fares."""
    points = check(footprint, sample_spacing_m=sample_spacing_m)
    every = materialise(offsets_across(aisles, points, on.resolution, offset_step_m), "offsets")
    routes = _offset_routes(every, points, on, sample_spacing_m)
    offset = F.col("offset_m")
    rank = [-F.col("clearance_p10_m"), -F.col("min_blocked_clearance_m"), F.col("candidate_overlap_pose_count"), F.abs(offset), offset]
    blocks = [F.col(c) for c in ("blocking_pose_count", "collision_pose_count", "unknown_overlap_pose_count", "out_of_bounds_pose_count")]

    def key(columns: list[Column]) -> Column:
        return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])

    row = F.struct("offset_m", "passed", *COUNTS, *CLEARANCES)
    chosen = routes.groupBy("aisle_id", "input_ord").agg(
        F.count(F.lit(1)).alias("tested_offset_count"),
        F.count_if("passed").alias("feasible_offset_count"),
        F.min(offset).alias("offset_min_m"),
        F.max(offset).alias("offset_max_m"),
        F.min_by(row, key([F.abs(offset), offset])).alias("centre"),
        F.min_by(row, F.when(F.col("passed"), key(rank))).alias("best"),
        F.min_by(row, key([*blocks, *rank])).alias("attempt"),
    )
    out = every.join(chosen, ["aisle_id", "input_ord"], "left").fillna(0, ["tested_offset_count", "feasible_offset_count"])
    centre = F.coalesce(F.col("centre.passed"), F.lit(False))
    best = F.col("feasible_offset_count") > 0
    kept = ("offset_m", "min_blocked_clearance_m", "clearance_p10_m", "candidate_overlap_pose_count")
    taken = {f"best_{c}": F.when(best, F.col(f"best.{c}")) for c in kept}
    tried = {f"best_attempt_{c}": F.col(f"attempt.{c}") for c in ("offset_m", "blocking_pose_count", "collision_pose_count")}
    tried["best_attempt_unknown_pose_count"] = F.col("attempt.unknown_overlap_pose_count")
    return out.select(
        "input_ord", "aisle_id", "label", F.coalesce("width_m", "width_across_m").alias("width_m"), F.coalesce("length_m", "length_along_m").alias("length_m"),
        F.col("yaw").alias("heading_rad"), "offset_min_m", "offset_max_m", "tested_offset_count", "feasible_offset_count",
        centre.alias("centerline_passed"), best.alias("passed"), (best & F.col("centre").isNotNull() & ~centre).alias("route_recovered"),
        *[c.alias(n) for n, c in (taken | tried).items()],
    )


def summary(results: DataFrame, **flags: str) -> DataFrame:
    """One row: pass, fail and total counts, the failed labels in input order, and for each flag's column its count
    and labels."""

    def listed(condition: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("input_ord", "label")))), lambda s: s["label"])

    passed = F.col("passed")
    extra = [F.count_if(F.col(c)).alias(f"{name}_count") for name, c in flags.items()] + [listed(F.col(c)).alias(f"{name}_aisles") for name, c in flags.items()]
    counts = [F.count_if(passed).alias("pass_count"), F.count_if(~passed).alias("fail_count"), F.count(F.lit(1)).alias("total_aisles")]
    return results.agg(*counts, listed(~passed).alias("failed_aisles"), *extra)


def route_segment(aisles: DataFrame, footprint: Footprint, resolution: float, offset: Column) -> DataFrame:
    """aisles with ``segment_start`` and ``segment_end``: the ends, in cells, of a constant-offset route."""
    reach = extents(check(footprint))
    frames = along(aisles, resolution)
    axis = Axis.columns()
    ends = [axis.at(F.lit(reach["rear"]), offset, resolution), axis.at(F.col("length_along_m") - reach["front"], offset, resolution)]
    return frames.withColumns({n: F.struct(x.alias("x"), y.alias("y")) for n, (x, y) in zip(("segment_start", "segment_end"), ends, strict=True)})
