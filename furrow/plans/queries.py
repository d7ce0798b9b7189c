"""The engine's operators as named queries over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.geometry import Axis
from furrow.operators import clearance, corridor, distance, grids, layers, segmentation, smooth_route, sweep
from furrow.operators.components import grid_components, large_components
from furrow.plans import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Digits that survive the different summation orders of two engines.
DIGITS = 6


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(name: str, column: Column | None = None) -> Column:
    return F.round(F.col(name) if column is None else column, DIGITS).alias(name)


def _ground(found: DataFrame) -> DataFrame:
    return found.groupBy("is_ground").agg(F.count(F.lit(1)).alias("n"), rounded("min_z", F.min("z")), rounded("max_z", F.max("z")))


@query
def height_threshold_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ground(segmentation.segment(t.points(spark, sf_dir), "height_threshold"))


@query
def height_threshold_two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ground(segmentation.near_level(t.points(spark, sf_dir)))


@query
def height_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.histogram(t.points(spark, sf_dir), 40).select("bin", rounded("left_edge"), "n")


@query
def histogram_mode_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ground(segmentation.segment(t.points(spark, sf_dir), "morphological_pmf", {"bins": 40, "height_threshold": 0.05}))


@query
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.bounding_box(t.points(spark, sf_dir))


@query
def height_grid_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.min_height_grid(t.points(spark, sf_dir), t.POINT_RESOLUTION)


@query
def height_grid_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.max_height_grid(t.points(spark, sf_dir), t.POINT_RESOLUTION).withColumn("h", rounded("h", F.col("h").cast("double")))


@query
def relative_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.relative_height(grids.min_height_grid(t.points(spark, sf_dir), t.POINT_RESOLUTION)).select("x", "y", "h", "ground", rounded("rel"))


@query
def traversability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.traversability_map(t.points(spark, sf_dir), t.POINT_RESOLUTION, 4).select("x", "y", "trav")


@query
def traversability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversability(spark, sf_dir).groupBy("trav").agg(F.count(F.lit(1)).alias("cells"))


@query
def ground_traversability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation first, then the map of the ground points alone, for either algorithm."""
    found = []
    for name in segmentation.list_algorithms():
        ground = segmentation.segment(t.points(spark, sf_dir), name).where("is_ground")
        found.append(grids.traversability_map(ground, t.POINT_RESOLUTION).groupBy("trav").agg(F.count(F.lit(1)).alias("cells")).withColumn("algorithm", F.lit(name)))
    return found[0].unionByName(found[1])


@query
def row_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corridor.row_direction(t.mask(spark, sf_dir)).select(*[rounded(c) for c in ("angle_rad", "dx", "dy")])


@query
def connected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large_components(grid_components(t.mask(spark, sf_dir)), 5).select("x", "y", "component", "size")


@query
def corridor_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = t.mask(spark, sf_dir).withColumn("trav", F.lit(grids.TRAVERSABLE))
    return corridor.skeletonise(corridor.extract_corridor(cells, corridor.row_direction(cells), 8)).select("x", "y")


def layers_of(spark: SparkSession, sf_dir: str, label: str = t.LABEL, lanes: DataFrame | None = None) -> DataFrame:
    return layers.navigation_layers(t.labels(spark, sf_dir, label), t.aisles(spark, sf_dir) if lanes is None else lanes)


@query
def navigation_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers_of(spark, sf_dir).select("x", "y", "base", "is_candidate", "is_aisle", "is_hard")


@query
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer_counts(layers_of(spark, sf_dir))


@query
def gray_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a value that the map must not hold."""
    cells = layers_of(spark, sf_dir).withColumn("base", F.when((F.col("x") == 0) & (F.col("y") == 0), 127).otherwise(F.col("base")))
    found = layers.gray_semantics(cells)
    return found.select(*[F.array_join(c, ",").alias(c) for c in ("observed_gray_values", "unexpected_gray_values")], "gray_semantics_valid")


@query
def clearance_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = layers_of(spark, sf_dir).select("x", "y", (F.col("base") != layers.FREE).alias("blocked"))
    return distance.distance_transform(cells).select("x", "y", "d2")


#: In cells of the grid: one cell and a bit, and two.
RADII = (0.1, 0.15, 0.2)


def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clearance.clearance_connectivity(layers_of(spark, sf_dir, t.SPARSE_LABEL), t.aisles(spark, sf_dir), t.GRID_RESOLUTION, RADII)


@query
def clearance_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectivity(spark, sf_dir)


@query
def clearance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clearance.clearance_summary(connectivity(spark, sf_dir))


def _geometry(lanes: DataFrame) -> DataFrame:
    axis = Axis.of(F.col("polygon"))
    found = sweep.route_segment(lanes, t.FOOTPRINT, t.GRID_RESOLUTION, F.lit(0.05))
    probe, other = axis.probes(0.1)
    return found.select(
        "aisle_id", "label", rounded("length_m", F.col("length_along_m")), rounded("width_m", F.col("width_across_m")), rounded("yaw"),
        rounded("probe_x", probe["x"]), rounded("probe_y", probe["y"]), rounded("other_x", other["x"]), rounded("other_y", other["y"]),
        rounded("start_x", F.col("segment_start.x")), rounded("start_y", F.col("segment_start.y")), rounded("end_x", F.col("segment_end.x")), rounded("end_y", F.col("segment_end.y")),
    )


@query
def aisle_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geometry(t.aisles(spark, sf_dir))


def map_of(spark: SparkSession, sf_dir: str, lanes: DataFrame | None = None, allow_unknown: bool = False) -> sweep.Map:
    return sweep.Map.of(layers_of(spark, sf_dir, t.SPARSE_LABEL, lanes), t.GRID_RESOLUTION, allow_unknown)


def _validation(found: DataFrame) -> DataFrame:
    keep = ("aisle_id", "label", "pose_count", "passed", "collision_pose_count", "unknown_overlap_pose_count", "candidate_overlap_pose_count", "out_of_bounds_pose_count", "first_failure_reason")
    return found.select(*keep, rounded("min_blocked_clearance_m"), rounded("first_failure_x", F.col("first_failure_pose.x_cell")))


@query
def footprint_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validation(sweep.validate_footprint(t.aisles(spark, sf_dir), t.FOOTPRINT, map_of(spark, sf_dir)))


@query
def footprint_validation_unknown_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validation(sweep.validate_footprint(t.aisles(spark, sf_dir), t.FOOTPRINT, map_of(spark, sf_dir, allow_unknown=True)))


@query
def oblique_aisle_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.aisle_cells(t.oblique_aisles(spark, sf_dir))


@query
def oblique_aisle_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geometry(t.oblique_aisles(spark, sf_dir))


@query
def oblique_footprint_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A footprint with a notch, turned with the aisles."""
    lanes = t.oblique_aisles(spark, sf_dir)
    return _validation(sweep.validate_footprint(lanes, t.NOTCHED, map_of(spark, sf_dir, lanes)))


@query
def oblique_offset_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = t.oblique_aisles(spark, sf_dir)
    return _offset_routes(sweep.offset_routes(lanes, t.FOOTPRINT, map_of(spark, sf_dir, lanes)))


@query
def footprint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sweep.summary(sweep.validate_footprint(t.aisles(spark, sf_dir), t.FOOTPRINT, map_of(spark, sf_dir)))
    return found.withColumn("failed_aisles", F.array_join("failed_aisles", ","))


@query
def offset_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sweep.offsets_across(t.aisles(spark, sf_dir), t.FOOTPRINT, t.GRID_RESOLUTION)
    return found.select("aisle_id", F.posexplode("offsets").alias("k", "offset_m")).select("aisle_id", "k", rounded("offset_m"))


def _offset_routes(found: DataFrame) -> DataFrame:
    keep = ("aisle_id", "passed", *sweep.COUNTS, "first_failure_reason")
    return found.select(*keep, rounded("offset_m"), *[rounded(c) for c in sweep.CLEARANCES])


@query
def offset_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offset_routes(sweep.offset_routes(t.aisles(spark, sf_dir), t.FOOTPRINT, map_of(spark, sf_dir)))


@query
def offset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sweep.search_offsets(t.aisles(spark, sf_dir), t.FOOTPRINT, map_of(spark, sf_dir))
    keep = ("aisle_id", "label", "tested_offset_count", "feasible_offset_count", "centerline_passed", "passed", "route_recovered", "best_candidate_overlap_pose_count", "best_attempt_blocking_pose_count", "best_attempt_collision_pose_count", "best_attempt_unknown_pose_count")
    return found.select(*keep, *[rounded(c) for c in ("offset_min_m", "offset_max_m", "best_offset_m", "best_clearance_p10_m", "best_min_blocked_clearance_m", "best_attempt_offset_m")])


def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    on, lanes = map_of(spark, sf_dir), t.aisles(spark, sf_dir)
    before = sweep.search_offsets(lanes, t.FOOTPRINT, on).select("label", "passed")
    return smooth_route.search_smooth_routes(lanes, t.FOOTPRINT, on, baseline=before)


@query
def smooth_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _smooth(spark, sf_dir).drop("route_points", "control_offsets_m", "input_ord")
    return found.select(*[rounded(c) if kind == "double" else c for c, kind in found.dtypes])


@query
def smooth_route_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offsets at the control points of every route, for a strict and a lenient map."""
    lanes, found = t.aisles(spark, sf_dir), []
    for lenient in (False, True):
        routes = smooth_route.search_smooth_routes(lanes, t.FOOTPRINT, map_of(spark, sf_dir, allow_unknown=lenient))
        found.append(routes.select(F.lit(lenient).alias("allow_unknown"), "aisle_id", F.posexplode("control_offsets_m").alias("k", "o")))
    return found[0].unionByName(found[1]).select("allow_unknown", "aisle_id", "k", rounded("offset_m", F.col("o")))


@query
def smooth_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where aisles have no route."""
    routes = smooth_route.search_smooth_routes(t.aisles(spark, sf_dir), t.FOOTPRINT, map_of(spark, sf_dir)).where("not passed")
    return routes.groupBy("failure_region", "failure_reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("aisle_id", "label"))), lambda s: s["label"]), ",").alias("labels"))


@query
def smooth_route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _smooth(spark, sf_dir).select("aisle_id", F.posexplode("route_points").alias("k", "p")).select("aisle_id", "k", "p.*")
    return points.select(*[rounded(c) if kind == "double" else c for c, kind in points.dtypes])
