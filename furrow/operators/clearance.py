"""Whether an aisle stays connected end to end for robots of several radii."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.batches import whole_runs
from furrow.functions.geometry import Axis
from furrow.functions.labels import label_cells
from furrow.functions.numbers import rounded_cell
from furrow.operators.distance import with_distance
from furrow.operators.layers import FREE, aisle_cells, labelled

RADII = (0.20, 0.25, 0.30, 0.35, 0.40, 0.50)
#: By how much, in metres, a distance may fall short of a radius.
TOLERANCE = 1e-12


def free_cells(cells: DataFrame, resolution: float, least: float) -> DataFrame:
    """cells(x, y, base): (x, y, dist_m) of the free cells at least ``least`` away from all that is not free."""
    near = with_distance(cells.select("x", "y", "base", (F.col("base") != FREE).alias("blocked")), resolution)
    return near.where((F.col("base") == FREE) & (F.col("dist_m") + TOLERANCE >= least)).select("x", "y", "dist_m")


def connected(part: pa.Table, radii: tuple[float, ...]) -> pa.Table:
    """(aisle_id, radius, ok) from the cells (aisle_id, x, y, dist_m, start, end) of whole aisles, sorted by aisle.

    All aisles are labelled at once, each on rows of its own.
    """
    ids, first, which = np.unique(part["aisle_id"].to_numpy(), return_index=True, return_inverse=True)
    x, y = (v - np.minimum.reduceat(v, first)[which] for v in (part[a].to_numpy().astype(np.int64) for a in "xy"))
    y += which * (y.max() + 2)
    dist, marks = part["dist_m"].to_numpy(), [part[m].to_numpy() for m in ("start", "end")]
    passed = []
    for radius in radii:
        safe = np.flatnonzero(dist + TOLERANCE >= radius)
        label = label_cells(x[safe], y[safe])
        ends = np.full((2, len(ids)), -1)
        for end, mark in zip(ends, marks, strict=True):
            at = mark[safe]
            end[which[safe][at]] = label[at]
        passed.append((ends[0] >= 0) & (ends[0] == ends[1]))
    names, values = ["aisle_id", "radius", "ok"], [np.tile(ids, len(radii)), np.repeat(np.array(radii, float), len(ids)), np.concatenate(passed)]
    return pa.table([pa.array(values[0], pa.int32()), *map(pa.array, values[1:])], names=names)


def clearance_connectivity(cells: DataFrame, aisles: DataFrame, resolution: float, radii: tuple[float, ...] = RADII, fraction: float = 0.1) -> DataFrame:
    """(aisle_id, label, radius, passed) for every aisle and radius.

    An aisle passes if its two probes, a tenth of the axis inside either end, are safe and connected within the
    aisle's own safe cells. An aisle's cells fit one task: they are what one polygon covers.
    """
    radii = tuple(float(r) for r in radii)
    asked = labelled(aisles).select("aisle_id", "label", F.explode(F.array(*[F.lit(r) for r in radii])).alias("radius"))
    probes = zip("se", Axis.of(F.col("polygon")).probes(fraction), strict=True)
    lanes = aisles.withColumns({f"{n}{a}": rounded_cell(p[a]) for n, p in probes for a in ("x", "y")})
    marks = [F.coalesce((F.col("x") == F.col(f"{m[0]}x")) & (F.col("y") == F.col(f"{m[0]}y")), F.lit(False)).alias(m) for m in ("start", "end")]
    own = aisle_cells(lanes, "sx", "sy", "ex", "ey").select("aisle_id", "x", "y", *marks)
    # cells by the hundred to an aisle: the planner, which sees the aisles' size, would broadcast them
    inside = own.hint("merge").join(free_cells(cells, resolution, min(radii, default=0.0)), ["x", "y"])

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, "aisle_id"):
            yield from connected(part, radii).to_batches()

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = inside.select("aisle_id", "x", "y", "dist_m", "start", "end").repartition(parts, "aisle_id").sortWithinPartitions("aisle_id")
    found = inside.mapInArrow(connect, "aisle_id int, radius double, ok boolean")
    return asked.join(found, ["aisle_id", "radius"], "left").select("aisle_id", "label", "radius", F.coalesce("ok", F.lit(False)).alias("passed"))


def clearance_summary(connectivity: DataFrame) -> DataFrame:
    """(key, radius_m, diameter_m, pass_count, total_aisles) for every radius."""
    return connectivity.groupBy(F.format_string("%.2f", "radius").alias("key"), F.col("radius").alias("radius_m")).agg(
        (2.0 * F.first("radius")).alias("diameter_m"), F.count_if("passed").alias("pass_count"), F.count(F.lit(1)).alias("total_aisles")
    )


def clearance_by_aisle(connectivity: DataFrame) -> DataFrame:
    """(aisle_id, label, clearance_pass map<string, boolean>)."""
    entry = F.struct(F.format_string("%.2f", "radius").alias("key"), F.col("passed").alias("value"))
    return connectivity.groupBy("aisle_id", "label").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("clearance_pass"))
