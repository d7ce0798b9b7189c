"""Plane geometry as column expressions. Polygons are array<struct<x double, y double>>.

Grid polygons are in cells, footprints in metres in the robot's frame (+x ahead, +y left).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

POLYGON = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def polygon(points: list[tuple[float, float]]) -> Column:
    return F.array(*[point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def coordinates(poly: Column, axis: str) -> Column:
    return F.transform(poly, lambda p: p[axis])


def _mid(a: Column, b: Column) -> Column:
    return point(0.5 * (a["x"] + b["x"]), 0.5 * (a["y"] + b["y"]))


@dataclass(frozen=True)
class Axis:
    """An aisle's centreline and its frame, as columns; the aisle's corners run around it from one end."""

    start: Column
    end: Column
    cells: Column
    ux: Column
    uy: Column
    width_cells: Column

    @classmethod
    def of(cls, poly: Column) -> Axis:
        start, end = _mid(poly[0], poly[3]), _mid(poly[1], poly[2])
        dx, dy = end["x"] - start["x"], end["y"] - start["y"]
        cells = F.sqrt(dx * dx + dy * dy)
        some = F.nullif(cells, F.lit(0.0))  # no direction without length
        ux, uy = dx / some, dy / some

        def across(a: Column, b: Column) -> Column:
            return F.abs((b["x"] - a["x"]) * -uy + (b["y"] - a["y"]) * ux)

        return cls(start, end, cells, ux, uy, F.least(across(poly[0], poly[3]), across(poly[1], poly[2])))

    @classmethod
    def columns(cls) -> Axis:
        """The axis that ``named`` has put into columns: later expressions stay small."""
        at = [F.col(f"axis_{n}") for n in ("x0", "y0", "x1", "y1", "cells", "ux", "uy", "width")]
        return cls(point(at[0], at[1]), point(at[2], at[3]), *at[4:])

    def named(self) -> dict[str, Column]:
        values = (self.start["x"], self.start["y"], self.end["x"], self.end["y"], self.cells, self.ux, self.uy, self.width_cells)
        return {f"axis_{n}": v for n, v in zip(("x0", "y0", "x1", "y1", "cells", "ux", "uy", "width"), values, strict=True)}

    @property
    def yaw(self) -> Column:
        return F.atan2(self.uy, self.ux)

    def at(self, distance_m: Column, offset_m: Column, resolution: float) -> tuple[Column, Column]:
        """Cell coordinates at a distance along the axis and an offset to its left."""
        d, o = distance_m / resolution, offset_m / resolution
        return self.start["x"] + self.ux * d - self.uy * o, self.start["y"] + self.uy * d + self.ux * o

    def probes(self, fraction: float) -> tuple[Column, Column]:
        """The points that lie a fraction of the axis inside either end."""
        dx, dy = fraction * (self.end["x"] - self.start["x"]), fraction * (self.end["y"] - self.start["y"])
        return point(self.start["x"] + dx, self.start["y"] + dy), point(self.end["x"] - dx, self.end["y"] - dy)


def extents(footprint: list[tuple[float, float]]) -> dict[str, float]:
    """How far a footprint reaches behind, ahead, right and left of its origin; never negative."""
    xs, ys = [p[0] for p in footprint], [p[1] for p in footprint]
    return {"rear": max(0.0, -min(xs)), "front": max(0.0, max(xs)), "right": max(0.0, -min(ys)), "left": max(0.0, max(ys))}


def placed(footprint: list[tuple[float, float]], x: Column, y: Column, yaw: Column, resolution: float) -> Column:
    """The footprint's polygon in cells at a pose."""
    c, s = F.cos(yaw), F.sin(yaw)
    return F.array(*[point(x + (c * fx - s * fy) / resolution, y + (s * fx + c * fy) / resolution) for fx, fy in footprint])


def leaves_grid(poly: Column, width: Column, height: Column) -> Column:
    """Whether any vertex lies outside the cells' centres."""
    return F.exists(poly, lambda p: (p["x"] < 0) | (p["x"] > width - 1) | (p["y"] < 0) | (p["y"] > height - 1))


def rounded(poly: Column) -> Column:
    return F.transform(poly, lambda p: point(F.rint(p["x"]), F.rint(p["y"])))

