"""Row direction by principal axes, and corridor extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.components import grid_components, large_components
from furrow.operators.grids import TRAVERSABLE


def principal_angle(x: Column, y: Column) -> Column:
    """Aggregate: the angle of the major axis of the points' covariance, in (-pi/2, pi/2]; 0 for fewer than two points.

    A 2x2 symmetric matrix has its major axis at half the angle of (variance difference, twice the covariance).
    """
    angle = 0.5 * F.atan2(2.0 * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y))
    return F.when(F.count(x) < 2, F.lit(0.0)).otherwise(angle)


def row_direction(points: DataFrame) -> DataFrame:
    """One row (angle_rad, dx, dy) of points(x, y) or of the observed cells of a grid. The axis has no sign."""
    angle = points.where("x is not null and y is not null").agg(principal_angle(F.col("x").cast("double"), F.col("y").cast("double")).alias("angle_rad"))
    return angle.select("angle_rad", F.cos("angle_rad").alias("dx"), F.sin("angle_rad").alias("dy"))


def direction_score(cells: DataFrame, direction: DataFrame) -> DataFrame:
    """One row: how well the cells' own axis follows ``direction`` (one row), 0 to 1; 0 for fewer than two cells."""
    own = cells.agg(F.count(F.lit(1)).alias("n"), principal_angle(F.col("x").cast("double"), F.col("y").cast("double")).alias("own"))
    along = F.abs(F.cos("own") * F.col("dx") + F.sin("own") * F.col("dy"))
    return own.crossJoin(direction.select("dx", "dy")).select(F.when(F.col("n") < 2, F.lit(0.0)).otherwise(along).alias("score"))  # one row each


def extract_corridor(cells: DataFrame, direction: DataFrame | None = None, min_width: int = 5, direction_threshold: float = 0.7) -> DataFrame:
    """Traversable cells (x, y, component) in connected regions of ``min_width`` cells or more.

    With a direction, the regions stay or go all together, by one score of all their cells.
    """
    regions = large_components(grid_components(cells.where(F.col("trav") == TRAVERSABLE)), min_width).select("x", "y", "component")
    if direction is None:
        return regions
    kept = direction_score(regions, direction).where(F.col("score") >= direction_threshold)
    return regions.join(F.broadcast(kept.select(F.lit(True).alias("keep"))), how="cross").drop("keep")  # one row or none


def skeletonise(corridor: DataFrame) -> DataFrame:
    """The centreline: the corridor itself, as thinning needs a library that the engine does not declare."""
    return corridor
