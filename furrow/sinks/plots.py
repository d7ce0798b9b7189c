"""The relations behind the engine's plots; drawing them is left to any plotting tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.geometry import Axis
from furrow.operators import grids
from furrow.operators.sweep import Footprint, route_segment


def grid_plot(cells: DataFrame, column: str) -> DataFrame:
    """(x, y, value) of every cell of the grid, unknown ones null."""
    return grids.dense(cells, {"value": F.col(column)})


def cloud_plot(points: DataFrame, resolution: float = 0.05) -> dict[str, DataFrame]:
    """Of a segmented cloud: the points from above by class, and its height grid."""
    return {"points": points.select("x", "y", "is_ground"), "heights": grid_plot(grids.max_height_grid(points, resolution), "h")}


def crop_window(aisles: DataFrame, label: str, margin: int) -> dict[str, int]:
    """The cells around one aisle: x0, x1, y0, y1; an unknown label fails."""
    corners = aisles.where(F.col("label") == label).limit(1).select(F.explode("polygon").alias("p"))
    row = corners.agg(*[f(f"p.{a}").alias(f"{a}{k}") for a in "xy" for k, f in ((0, F.min), (1, F.max))]).first()
    if row["x0"] is None:
        raise ValueError(f"no aisle {label!r}")
    return {n: int(row[n]) + (margin if n.endswith("1") else -margin) for n in ("x0", "x1", "y0", "y1")}


def _image(x: str, y: str, height: int) -> list:
    """Image coordinates: rows run down from the top."""
    return [F.round(F.col(x)).cast("int"), F.round(F.lit(height - 1) - F.col(y)).cast("int")]


def offset_overlay(results: DataFrame, aisles: DataFrame, footprint: Footprint, resolution: float, height: int) -> DataFrame:
    """(label, kind, x0, y0, x1, y1) in image cells: each aisle's centreline and its chosen or best attempted route."""
    lanes = aisles.select("aisle_id", "label", "polygon", "width_m", "length_m").join(results.select("aisle_id", "passed", "route_recovered", F.coalesce("best_offset_m", "best_attempt_offset_m").alias("o")), "aisle_id")
    found = []
    for kind, offset in ((F.lit("centreline"), F.lit(0.0)), (F.when(~F.col("passed"), "attempt").when(F.col("route_recovered"), "recovered").otherwise("route"), F.col("o"))):
        ends = route_segment(lanes, footprint, resolution, offset).select("label", kind.alias("kind"), *[F.col(f"segment_{e}.{a}").alias(f"{a}{k}") for k, e in ((0, "start"), (1, "end")) for a in "xy"])
        found.append(ends.where("x0 is not null").select("label", "kind", *[c.alias(n) for k in (0, 1) for c, n in zip(_image(f"x{k}", f"y{k}", height), (f"x{k}", f"y{k}"), strict=True)]))
    return found[0].unionByName(found[1])


def within(drawn: DataFrame, window: dict[str, int], height: int) -> DataFrame:
    """drawn with ``shown``: whether a line, in image cells, has an end in the window of map cells."""
    top, bottom = height - 1 - window["y1"], height - 1 - window["y0"]

    def inside(k: int) -> Column:
        return F.col(f"x{k}").between(window["x0"], window["x1"]) & F.col(f"y{k}").between(top, bottom)

    return drawn.withColumn("shown", inside(0) | inside(1))


def smooth_overlay(results: DataFrame, height: int) -> DataFrame:
    """(label, kind, k, x, y) in image cells: the points of every smooth route in order."""
    kind = F.when(F.col("route_recovered_from_b1"), "recovered").otherwise("route")
    points = results.where("passed").select("label", kind.alias("kind"), F.posexplode("route_points").alias("k", "p")).select("label", "kind", "k", "p.x_cell", "p.y_cell")
    x, y = _image("x_cell", "y_cell", height)
    return points.select("label", "kind", "k", x.alias("x"), y.alias("y"))


def aisle_outlines(aisles: DataFrame) -> DataFrame:
    """(aisle_id, k, x, y): corners in order, and the axis' ends as k = 4 and 5."""
    axis = Axis.of(F.col("polygon"))
    return aisles.select("aisle_id", F.posexplode(F.concat("polygon", F.array(axis.start, axis.end))).alias("k", "p")).select("aisle_id", "k", "p.x", "p.y")
