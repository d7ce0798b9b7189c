"""Named queries through files: what the sinks write, in the shared folder, and the sources read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.geometry import Axis
from furrow.operators import clearance, corridor, grids, layers, segmentation, smooth_route, sweep
from furrow.plans import tables as t
from furrow.plans.queries import RADII, connectivity, corridor_cells, layers_of, map_of, query, rounded
from furrow.sinks import files as out
from furrow.sinks import plots
from furrow.sources import files as src
from furrow.storage import new_folder


def _lines(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A CSV's columns as text; empty ones are empty."""
    return spark.read.csv(path, header=True).select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


@query
def point_cloud_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary cloud, read by many ranges; equal points count."""
    points = t.points(spark, sf_dir).select(*[F.col(c).cast("float") for c in "xyz"])
    path = f"{new_folder(spark, 'cloud')}/cloud.pcd"
    out.write_pcd(points, path)
    return src.read_pcd(spark, path, 1 << 16).groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n")).select(*[rounded(c, F.col(c).cast("double")) for c in "xyz"], "n")


@query
def label_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark, 'labels')}/semantic_labels.npy"
    out.write_npy(out.to_array(t.labels(spark, sf_dir), "label", 0, np.uint8), path)
    return src.read_labels(spark, path)


@query
def map_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark, 'image')}/map.pgm"
    out.write_grids(layers_of(spark, sf_dir), {path: ("base", layers.UNKNOWN)})
    return src.read_pgm(spark, path)


def _bundle(spark: SparkSession, sf_dir: str) -> str:
    folder = new_folder(spark, "bundle")
    out.write_navigation_bundle(t.labels(spark, sf_dir, t.SPARSE_LABEL), t.aisles(spark, sf_dir), folder, t.GRID_RESOLUTION, radii=RADII)
    return folder


@query
def bundle_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _bundle(spark, sf_dir)
    masks = [src.read_mask(spark, f"{folder}/{name}.npy", column) for name, column in (("candidate_mask", "is_candidate"), ("static_obstacle_mask", "is_hard"))]
    image = src.read_pgm(spark, f"{folder}/navigation_base_map.pgm")
    return masks[0].join(masks[1].hint("merge"), ["x", "y"]).join(image.hint("merge"), ["x", "y"])  # cells of a small file are many rows


@query
def bundle_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation and the YAML of a bundle."""
    folder = _bundle(spark, sf_dir)
    counts = [f"{n}_cell_count" for n in ("candidate", "hard_obstacle", "hard_obstacle_as_free", "pillar", "pillar_as_free", "free", "unknown", "occupied")]
    flags = ["gray_semantics_valid", "static_obstacle_semantics_valid", "map_server_yaml_valid"]
    tests = "clearance_tests map<string,struct<radius_m:double,diameter_m:double,pass_count:long,total_aisles:long>>"
    lanes = "aisles array<struct<aisle_id:int,label:string,width_m:double,clearance_pass:map<string,boolean>>>"
    schema = ", ".join([*[f"{c} long" for c in counts], *[f"{c} boolean" for c in flags], "observed_gray_values array<int>", "resolution_m double", tests, lanes])
    found = spark.read.schema(schema).json(f"{folder}/validation.json", multiLine=True)
    metadata = src.read_map_metadata(spark, f"{folder}/navigation_base_map.yaml")
    passed = F.aggregate(F.map_values("clearance_tests"), F.lit(0).cast("long"), lambda n, v: n + v["pass_count"])
    by_aisle = F.aggregate("aisles", F.lit(0).cast("long"), lambda n, a: n + F.size(F.map_filter(a["clearance_pass"], lambda _, ok: ok)))
    return found.select(
        *counts, *flags, F.array_join("observed_gray_values", ",").alias("observed_gray_values"), "resolution_m", F.size("aisles").alias("aisles"),
        passed.alias("passed_tests"), by_aisle.alias("passed_by_aisle"), F.col("aisles")[0]["label"].alias("first_label"),
        *[F.lit(metadata[k]).alias(k) for k in ("image", "mode", "resolution", "occupied_thresh", "free_thresh")],
    )


@query
def aisle_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aisles as a list and as an object with rectangles, corner by corner."""
    rows = t.aisles(spark, sf_dir).orderBy("aisle_id").select("aisle_id", F.transform("polygon", lambda p: F.array(p["x"], p["y"])).alias("polygon_xy"), F.lit(0.4).alias("width_m"))
    lanes = out.records(rows)
    folder, found = new_folder(spark, "aisles"), []
    for name, data in (("bare", lanes), ("named", {"rectangles": lanes})):
        out.write_json(data, f"{folder}/{name}.json")
        read = src.read_aisles(spark, f"{folder}/{name}.json").select("aisle_id", "label", "width_m", "length_m", "input_ord", F.posexplode("polygon").alias("k", "p"))
        found.append(read.select(F.lit(name).alias("form"), "aisle_id", F.coalesce("label", F.lit("")).alias("label"), "width_m", F.col("length_m").isNull().alias("no_length"), "input_ord", "k", "p.x", "p.y"))
    return found[0].unionByName(found[1])


@query
def footprint_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A footprint with a name and one without, vertex by vertex."""
    folder, rows = new_folder(spark, "footprint"), []
    for name, data in (("a", {"name": "cart"}), ("b", {})):
        out.write_json(data | {"polygon_xy_m": t.FOOTPRINT}, f"{folder}/{name}.json")
        own, polygon = src.read_footprint(spark, f"{folder}/{name}.json")
        rows += [(own, k, x, y) for k, (x, y) in enumerate(polygon)]
    return spark.createDataFrame(rows, "name string, k int, x double, y double")


@query
def footprint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "report")
    out.write_report(sweep.validate_footprint(t.aisles(spark, sf_dir), t.FOOTPRINT, map_of(spark, sf_dir)), "check", out.FOOTPRINT_COLUMNS, folder)
    rows = _lines(spark, f"{folder}/check.csv", out.FOOTPRINT_COLUMNS)
    return rows.withColumn("min_blocked_clearance_m", F.round(F.col("min_blocked_clearance_m").try_cast("double"), 6))


def _offset_report(spark: SparkSession, sf_dir: str) -> str:
    folder = new_folder(spark, "report")
    found = sweep.search_offsets(t.aisles(spark, sf_dir), t.FOOTPRINT, map_of(spark, sf_dir))
    out.write_report(found, "offsets", out.OFFSET_COLUMNS, folder, recovered_route="route_recovered", centerline_pass="centerline_passed")
    return folder


@query
def offset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, f"{_offset_report(spark, sf_dir)}/offsets.csv", out.OFFSET_COLUMNS)
    return rows.select(*[F.round(F.col(c).try_cast("double"), 6).alias(c) if c.endswith("_m") else F.col(c) for c in out.OFFSET_COLUMNS])


@query
def offset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the console prints of a search: counts and labels."""
    schema = "summary struct<pass_count:long,fail_count:long,total_aisles:long,failed_aisles:array<string>,recovered_route_count:long,recovered_route_aisles:array<string>,centerline_pass_count:long>"
    found = spark.read.schema(schema).json(f"{_offset_report(spark, sf_dir)}/offsets.json", multiLine=True).select("summary.*")
    return found.withColumns({c: F.array_join(c, ",") for c in ("failed_aisles", "recovered_route_aisles")})


@query
def baseline_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier search as the smooth one reads it."""
    found = src.read_baseline(spark, f"{_offset_report(spark, sf_dir)}/offsets.json")
    return found.select("ord", "label", "passed", rounded("best_offset_m"), rounded("best_attempt_offset_m"))


def smooth_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smooth search with an earlier search's file as its baseline."""
    baseline = src.read_baseline(spark, f"{_offset_report(spark, sf_dir)}/offsets.json")
    return smooth_route.search_smooth_routes(t.aisles(spark, sf_dir), t.FOOTPRINT, map_of(spark, sf_dir), baseline=baseline)


@query
def smooth_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "report")
    out.write_report(smooth_from_files(spark, sf_dir), "smooth", out.SMOOTH_COLUMNS, folder, recovered_from_b1="route_recovered_from_b1", baseline_b1_pass="b1_passed")
    rows = _lines(spark, f"{folder}/smooth.csv", out.SMOOTH_COLUMNS)
    return rows.select(*[F.round(F.col(c).try_cast("double"), 6).alias(c) if c.endswith(("_m", "_rad")) else F.col(c) for c in out.SMOOTH_COLUMNS])


@query
def centreline_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corridor's cells as a file, each with its line's number."""
    path = f"{new_folder(spark, 'corridor')}/centerline.csv"
    out.write_centreline(corridor_cells(spark, sf_dir), path)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim(F.regexp_replace("value", "\r", "")), "\n")).alias("line", "text"))
    return lines.select("line", F.trim("text").alias("text")).where("text <> ''")


@query
def corridor_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corridor's description as a file."""
    path = f"{new_folder(spark, 'corridor')}/metadata.yaml"
    cells = t.mask(spark, sf_dir).withColumn("trav", F.lit(grids.TRAVERSABLE))
    angle = corridor.row_direction(cells).first()
    found = {"experiment": "corridor", "row_angle_rad": angle["angle_rad"], "row_direction": [angle["dx"], angle["dy"]], "points": cells.count()}
    out.write_yaml(found | {"corridor_cells": corridor_cells(spark, sf_dir).count()}, path)
    read = src.read_map_metadata(spark, path)
    row = (read["experiment"], round(read["row_angle_rad"], 6), *[round(v, 6) for v in read["row_direction"]], read["points"], read["corridor_cells"])
    return spark.createDataFrame([row], "experiment string, row_angle_rad double, dx double, dy double, points long, corridor_cells long")


@query
def report_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "page")
    out.write_html(folder, ["height<1>.png", "b/c.png"], "Maps & routes")
    return spark.read.text(f"{folder}/report.html", wholetext=True).select(F.trim(F.regexp_replace("value", "\n", "")).alias("page"))


@query
def voxel_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a voxel has no effect."""
    found = segmentation.voxel_ground(t.points(spark, sf_dir), 3.0)
    return found.groupBy("is_ground").agg(F.count(F.lit(1)).alias("n"), rounded("min_z", F.min("z")), rounded("max_z", F.max("z")))


@query
def refused_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which wrong inputs are refused."""
    lanes, on = t.aisles(spark, sf_dir), map_of(spark, sf_dir)
    flat = lanes.withColumn("polygon", F.transform("polygon", lambda _: F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))))
    good = layers.map_metadata("a.pgm", 0.05)

    def evaluate(rows: DataFrame) -> None:  # every row, none of which the driver needs
        rows.write.format("noop").mode("overwrite").save()

    cases = {
        "two vertices": lambda: sweep.validate_footprint(lanes, t.FOOTPRINT[:2], on),
        "no spacing": lambda: sweep.validate_footprint(lanes, t.FOOTPRINT, on, 0.0),
        "negative step": lambda: sweep.offset_routes(lanes, t.FOOTPRINT, on, offset_step_m=-0.05),
        "no resolution": lambda: sweep.Map.of(layers_of(spark, sf_dir), 0.0),
        "no axis": lambda: evaluate(sweep.along(flat, t.GRID_RESOLUTION)),
        "three corners": lambda: evaluate(sweep.along(lanes.withColumn("polygon", F.slice("polygon", 1, 3)), t.GRID_RESOLUTION)),
        "negative change": lambda: smooth_route.transitions(smooth_route.lattice(lanes, t.FOOTPRINT, t.GRID_RESOLUTION), -0.1),
        "negative trim": lambda: smooth_route.lattice(lanes, t.FOOTPRINT, t.GRID_RESOLUTION, endpoint_trim_m=-0.1),
        "good": lambda: evaluate(sweep.along(lanes, t.GRID_RESOLUTION)),
    }
    rows = []
    for name, call in cases.items():
        try:
            call()
            rows.append((name, False))
        except Exception:  # whatever its kind, the input was refused
            rows.append((name, True))
    rows += [("yaml: " + k, not layers.metadata_valid(good | v)) for k, v in {"good": {}, "mode": {"mode": "scale"}, "thresholds": {"free_thresh": 0.7}, "range": {"occupied_thresh": 1.5}}.items()]
    return spark.createDataFrame(rows, "case string, refused boolean")


@query
def height_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The height grid as it is drawn: every cell, unknown ones without a value."""
    return plots.cloud_plot(t.points(spark, sf_dir).withColumn("is_ground", F.lit(True)), t.POINT_RESOLUTION)["heights"].select("x", "y", rounded("value", F.col("value").cast("double")))


@query
def segmented_cloud_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud from above, by class."""
    points = plots.cloud_plot(segmentation.segment(t.points(spark, sf_dir)), t.POINT_RESOLUTION)["points"]
    return points.groupBy(rounded("x"), rounded("y"), "is_ground").agg(F.count(F.lit(1)).alias("n"))


@query
def offset_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each aisle's centreline and route in the image, and whether it lies in the window around aisle A01."""
    on, lanes = map_of(spark, sf_dir), layers.labelled(t.aisles(spark, sf_dir))
    drawn = plots.offset_overlay(sweep.search_offsets(lanes, t.FOOTPRINT, on), lanes, t.FOOTPRINT, t.GRID_RESOLUTION, on.height)
    return plots.within(drawn, plots.crop_window(lanes, "A01", 3), on.height)


@query
def smooth_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = map_of(spark, sf_dir)
    found = smooth_route.search_smooth_routes(t.aisles(spark, sf_dir), t.FOOTPRINT, on)
    return plots.smooth_overlay(found, on.height)


@query
def aisle_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plots.aisle_outlines(t.aisles(spark, sf_dir))


@query
def aisle_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place a metre along each axis and half a cell to its left."""
    axis = Axis.of(F.col("polygon"))
    x, y = axis.at(F.lit(1.0), F.lit(0.05), t.GRID_RESOLUTION)
    return t.aisles(spark, sf_dir).select("aisle_id", rounded("x", x), rounded("y", y))


@query
def clearance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each aisle's results by radius, from the map of keys to flags."""
    rows = clearance.clearance_by_aisle(connectivity(spark, sf_dir))
    return rows.select("aisle_id", "label", F.explode("clearance_pass").alias("key", "passed"))

