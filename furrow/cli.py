"""python -m furrow.cli COMMAND …: the engine's dataflows over files.

compare, benchmark, corridor, navigation-map, footprint, offsets, smooth
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import clearance, corridor, grids, segmentation, smooth_route, sweep
from furrow.sinks import files as out
from furrow.sources import files as src


def _points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else src.read_pcd(spark, path)


def compare(spark: SparkSession, cloud: str, resolution: float = 0.05) -> dict:
    """For each algorithm: ground and other points, and the classes of the ground's traversability map."""
    points, found = _points(spark, cloud), {}
    for name in segmentation.list_algorithms():
        split = segmentation.segment(points, name)
        counts = split.agg(F.count_if("is_ground").alias("ground"), F.count_if(~F.col("is_ground")).alias("non_ground")).first().asDict()
        classes = grids.traversability_map(split.where("is_ground"), resolution).groupBy("trav").count().collect()
        found[name] = counts | {"cells": {int(r["trav"]): r["count"] for r in classes}}
    return found


def benchmark(spark: SparkSession, cloud: str) -> dict:
    """Points, ground points and other points of the two-sided threshold."""
    row = segmentation.near_level(_points(spark, cloud)).agg(F.count(F.lit(1)).alias("points"), F.count_if("is_ground").alias("ground")).first()
    return {"points": row["points"], "ground": row["ground"], "non_ground": row["points"] - row["ground"]}


def recover_corridor(spark: SparkSession, cloud: str, folder: str, resolution: float = 0.05, experiment: str = "corridor") -> dict:
    """The whole cloud's traversability, its row direction, and the corridor's cells as a centreline file."""
    points = _points(spark, cloud).persist()
    cells = grids.traversability_map(points, resolution).persist()
    direction = corridor.row_direction(cells).persist()
    line = corridor.skeletonise(corridor.extract_corridor(cells, direction))
    Path(folder).mkdir(parents=True, exist_ok=True)
    angle = direction.first()
    values = {"experiment": experiment, "row_angle_rad": angle["angle_rad"], "row_direction": [angle["dx"], angle["dy"]], "points": points.count(), "corridor_cells": out.write_centreline(line, Path(folder) / "centerline.csv")}
    out.write_yaml(values, Path(folder) / "metadata.yaml")
    return values


def navigation_map(spark: SparkSession, labels: str, aisles: str, folder: str, resolution: float = 0.05, radii: tuple[float, ...] = clearance.RADII) -> dict:
    return out.write_navigation_bundle(src.read_labels(spark, labels), src.read_aisles(spark, aisles), folder, resolution, radii=radii)


def _map(spark: SparkSession, image: str, metadata: str, candidates: str | None, allow_unknown: bool) -> sweep.Map:
    cells = src.read_pgm(spark, image)
    if candidates:
        mask = src.read_mask(spark, candidates)
        if cells.agg(F.max("x"), F.max("y")).first() != mask.agg(F.max("x"), F.max("y")).first():
            raise ValueError("the candidate mask and the map differ in shape")
        cells = cells.join(mask, ["x", "y"])
    return sweep.Map.of(cells, float(src.read_map_metadata(spark, metadata)["resolution"]), allow_unknown)


def routes(spark: SparkSession, kind: str, image: str, metadata: str, aisles: str, footprint: str, folder: str, candidates: str | None = None, allow_unknown: bool = False, baseline: str | None = None, sample_spacing: float = 0.10, offset_step: float = 0.05, control_spacing: float = 0.50, max_offset_change: float = 0.10, endpoint_trim: float = 0.0) -> dict:
    """Footprint check, constant offsets or smooth routes, as JSON and CSV; returns the report."""
    on, lanes = _map(spark, image, metadata, candidates, allow_unknown), src.read_aisles(spark, aisles)
    name, polygon = src.read_footprint(spark, footprint)
    policy = {"allow_unknown": allow_unknown, "sample_spacing_m": sample_spacing}
    more = {"footprint": {"name": name, "polygon_xy_m": [list(p) for p in polygon]}, "resolution_m": on.resolution, "policy": policy}
    if kind == "footprint":
        return out.write_report(sweep.validate_footprint(lanes, polygon, on, sample_spacing), "aisle_footprint_validation", out.FOOTPRINT_COLUMNS, folder, more)
    policy |= {"offset_step_m": offset_step}
    if kind == "offsets":
        policy |= {"search_model": "constant_lateral_offset"}
        found = sweep.search_offsets(lanes, polygon, on, sample_spacing, offset_step)
        return out.write_report(found, "in_aisle_offset_search", out.OFFSET_COLUMNS, folder, more, recovered_route="route_recovered", centerline_pass="centerline_passed")
    policy |= {"search_model": "smooth_lateral_offset_lattice", "control_spacing_m": control_spacing, "max_offset_change_m": max_offset_change, "endpoint_trim_m": endpoint_trim}
    found = smooth_route.search_smooth_routes(lanes, polygon, on, sample_spacing, control_spacing, offset_step, max_offset_change, endpoint_trim, src.read_baseline(spark, baseline))
    return out.write_report(found, "smooth_lateral_routes", out.SMOOTH_COLUMNS, folder, more, recovered_from_b1="route_recovered_from_b1", baseline_b1_pass="b1_passed")


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("compare", "benchmark", "corridor"):
        own = commands.add_parser(name)
        own.add_argument("cloud")
        if name != "benchmark":
            own.add_argument("--resolution", type=float, default=0.05)
        if name == "corridor":
            own.add_argument("--output", required=True)
    own = commands.add_parser("navigation-map")
    for flag in ("--labels", "--aisles", "--output"):
        own.add_argument(flag, required=True)
    own.add_argument("--resolution", type=float, default=0.05)
    own.add_argument("--radii", type=float, nargs="+", default=list(clearance.RADII))
    for name in ("footprint", "offsets", "smooth"):
        own = commands.add_parser(name)
        for flag in ("--map", "--yaml", "--aisles", "--footprint", "--output"):
            own.add_argument(flag, required=True)
        own.add_argument("--candidates")
        own.add_argument("--allow-unknown", action="store_true")
        own.add_argument("--sample-spacing", type=float, default=0.10)
        own.add_argument("--offset-step", type=float, default=0.05)
        own.add_argument("--control-spacing", type=float, default=0.50)
        own.add_argument("--max-offset-change", type=float, default=0.10)
        own.add_argument("--endpoint-trim", type=float, default=0.0)
        own.add_argument("--baseline")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "compare":
        result = compare(spark, a.cloud, a.resolution)
    elif a.command == "benchmark":
        result = benchmark(spark, a.cloud)
    elif a.command == "corridor":
        result = recover_corridor(spark, a.cloud, a.output, a.resolution)
    elif a.command == "navigation-map":
        result = navigation_map(spark, a.labels, a.aisles, a.output, a.resolution, tuple(a.radii))
    else:
        result = routes(spark, a.command, a.map, a.yaml, a.aisles, a.footprint, a.output, a.candidates, a.allow_unknown, a.baseline, a.sample_spacing, a.offset_step, a.control_spacing, a.max_offset_change, a.endpoint_trim)
    print(json.dumps(result.get("summary", result), indent=2, default=str))
    return result


if __name__ == "__main__":
    main()
