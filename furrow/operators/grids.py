"""Height grids as sparse cells(x, y, h): a cell without a point has no row, and null means unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes of traversability.
UNKNOWN, TRAVERSABLE, OBSTACLE = 0, 1, 2


def bounding_box(points: DataFrame) -> DataFrame:
    """One row: min_x, max_x, min_y, max_y."""
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])


def _index(value: Column, origin: Column, resolution: float, single: bool) -> Column:
    """floor((value - origin) / resolution), in the precision of the input."""
    if single:
        scaled = (value - origin).cast("double") / F.lit(resolution).cast("float").cast("double")
        return F.floor(scaled.cast("float")).cast("int")
    return F.floor((value - origin) / resolution).cast("int")


def binned(points: DataFrame, resolution: float) -> DataFrame:
    """points with cell indices ``cx``, ``cy``, counted from the least x and y of these points."""
    if resolution <= 0:
        raise ValueError("resolution must be positive")
    kinds = dict(points.dtypes)
    origin = points.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    placed = points.crossJoin(F.broadcast(origin))  # one row
    return placed.withColumns({
        "cx": _index(F.col("x"), F.col("_x0"), resolution, kinds["x"] == "float"),
        "cy": _index(F.col("y"), F.col("_y0"), resolution, kinds["y"] == "float"),
    }).drop("_x0", "_y0")


def min_height_grid(points: DataFrame, resolution: float = 0.05) -> DataFrame:
    return binned(points, resolution).groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.min("z").cast("double").alias("h"))


def max_height_grid(points: DataFrame, resolution: float = 0.05) -> DataFrame:
    """The highest point of each cell, single precision; without points one unknown-height cell of 0 at the origin."""
    grid = binned(points, resolution).groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.max("z").cast("float").alias("h"))
    none = points.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0.0).cast("float").alias("h"))
    return grid.unionByName(none)


def local_ground(cells: DataFrame, kernel_size: int = 5) -> DataFrame:
    """cells with ``ground``: the least height in the kernel_size x kernel_size window around each observed cell.

    Windows are cut at the grid's edge, which for a minimum equals reflecting it. Heights spread along x by a grouped
    minimum, which combines before it shuffles, then along y by a window over the sparse column.
    """
    if kernel_size < 1:
        raise ValueError("kernel_size must be positive")
    before = kernel_size // 2
    after = kernel_size - 1 - before
    reach = F.explode(F.sequence(F.lit(-after), F.lit(before))).alias("dx")
    spread = cells.where("h is not null").select("x", "y", "h", reach)
    rows = spread.groupBy((F.col("x") + F.col("dx")).alias("x"), "y").agg(F.min("h").alias("least"), F.max(F.when(F.col("dx") == 0, F.col("h"))).alias("h"))
    column = Window.partitionBy("x").orderBy("y").rangeBetween(-before, after)
    return rows.withColumn("ground", F.min("least").over(column)).where("h is not null").select("x", "y", "h", "ground")


def relative_height(cells: DataFrame, kernel_size: int = 5) -> DataFrame:
    """cells with ``rel``: the height above the local ground."""
    return local_ground(cells, kernel_size).withColumn("rel", F.col("h") - F.col("ground"))


def traversability(relative: DataFrame, max_step: float = 0.15) -> DataFrame:
    """relative cells with ``trav``: unknown, traversable, or an obstacle where the step is above ``max_step``."""
    step = F.col("rel")
    return relative.withColumn("trav", F.when(step.isNull(), UNKNOWN).when(step > F.lit(max_step).cast("double"), OBSTACLE).otherwise(TRAVERSABLE))


def traversability_map(points: DataFrame, resolution: float = 0.05, kernel_size: int = 5) -> DataFrame:
    """Points to classes: least heights, local ground, relative heights, steps."""
    return traversability(relative_height(min_height_grid(points, resolution), kernel_size))


def dense(cells: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Every cell of the grid that ``cells`` spans from (0, 0), with the given columns; absent cells are null.

    For plots and exports: the grid's whole area is generated.
    """
    size = cells.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h_"))
    spine = size.select(F.explode(F.sequence(F.lit(0), F.col("h_") - 1)).alias("y"), "w").select("y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    return spine.join(cells.select("x", "y", *[c.alias(n) for n, c in columns.items()]), ["x", "y"], "left")
