"""Points, grids and aisles as views of the benchmark tables, for queries that need inputs at every scale.

The expressions are plain SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A point cloud: 97 x 61 cells of 0.05 m, with a gap after every fifth column and every seventh row.
POINTS = {
    "x": "cast(l_partkey % 97 + floor(l_partkey % 97 / 5) as double) * cast(0.05 as double) + cast(0.025 as double)",
    "y": "cast(l_suppkey % 61 + floor(l_suppkey % 61 / 7) as double) * cast(0.05 as double) + cast(0.025 as double)",
    "z": "l_discount * cast(2 as double)",
}
POINT_RESOLUTION = 0.05

#: A label grid, 120 cells wide, one cell per order; and a second one with few obstacles, for routes.
CELL = {"x": "cast(o_orderkey % 120 as int)", "y": "cast(floor(o_orderkey / 120) as int)"}
LABEL = "case when o_custkey % 40 < 2 then 2 when o_custkey % 40 = 2 then 6 when o_custkey % 40 = 3 then 5 when o_custkey % 40 < 12 then 0 else 1 end"
SPARSE_LABEL = "case when o_custkey % 211 = 0 then 2 when o_custkey % 97 = 0 then 5 when o_custkey % 3 = 0 then 1 else 0 end"
#: Cells of a mask about half full, so that its regions are small.
MASK = "o_custkey % 40 < 20"

#: Aisles: strips of the grid, 115 x 4 cells.
AISLE_X0, AISLE_X1 = 2, 117
AISLE_Y0, AISLE_Y1 = "6 * s_suppkey + 1", "6 * s_suppkey + 5"
GRID_RESOLUTION = 0.1
#: Oblique aisles: rectangles of 65 x 6.5 cells that climb 25 cells over 60, to the right for even numbers and to the left for odd ones.
OBLIQUE = ((5.0, 0.0), (65.0, 25.0), (62.5, 31.0), (2.5, 6.0))
OBLIQUE_Y, OBLIQUE_TOP = "5 * s_suppkey + 1", 31
#: A rectangle that fits an aisle with room to either side, in metres.
FOOTPRINT = [(0.12, 0.08), (0.12, -0.08), (-0.12, -0.08), (-0.12, 0.08)]
#: One that is not convex.
NOTCHED = [(0.31, 0.17), (0.08, 0.02), (0.29, -0.21), (-0.33, -0.19), (-0.27, 0.23)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z) from lineitem."""
    return table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in POINTS.items()])


def labels(spark: SparkSession, sf_dir: str, label: str = LABEL) -> DataFrame:
    """(x, y, label) from orders."""
    return table(spark, sf_dir, "orders").select(*[F.expr(e).alias(n) for n, e in CELL.items()], F.expr(label).alias("label"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y) from orders."""
    return table(spark, sf_dir, "orders").where(MASK).select(*[F.expr(e).alias(n) for n, e in CELL.items()])


def _on_grid(spark: SparkSession, sf_dir: str, corners: list[tuple[Column, Column]], top: Column) -> DataFrame:
    """(aisle_id, label, polygon, width_m, length_m): the suppliers' aisles that lie within the grid."""
    rows = table(spark, sf_dir, "orders").agg(F.max(F.expr(CELL["y"])).alias("top"))
    polygon = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])
    found = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(rows)).where(top <= F.col("top"))  # one row
    none = F.lit(None)
    return found.select(F.col("s_suppkey").cast("int").alias("aisle_id"), none.cast("string").alias("label"), polygon.alias("polygon"), none.cast("double").alias("width_m"), none.cast("double").alias("length_m"))


def aisles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips along the rows."""
    corners = [(AISLE_X0, AISLE_Y0), (AISLE_X1, AISLE_Y0), (AISLE_X1, AISLE_Y1), (AISLE_X0, AISLE_Y1)]
    return _on_grid(spark, sf_dir, [(F.lit(x), F.expr(y)) for x, y in corners], F.expr(AISLE_Y1))


def oblique_aisles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles across the rows, either way."""
    base, left = F.expr(OBLIQUE_Y), F.col("s_suppkey") % 2 == 1
    corners = [(F.when(left, F.lit(119.0 - x)).otherwise(F.lit(x)), base + F.lit(y)) for x, y in OBLIQUE]
    return _on_grid(spark, sf_dir, corners, base + OBLIQUE_TOP)
