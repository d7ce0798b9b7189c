"""Cells that polygons cover, by Arrow batches: an area is an outline of integer vertices and what it encloses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.geometry import coordinates, rounded


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The convex hull, counter-clockwise, without points inside its sides."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(run: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def covered(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of the cells that a polygon covers, row by row.

    A cell counts if its centre is inside (an odd number of sides cross the ray to its right) or if a side, drawn from
    cell to cell along its longer axis, passes through it.
    """
    low_x, low_y = int(xs.min()), int(ys.min())
    x, y = np.arange(low_x, int(xs.max()) + 1), np.arange(low_y, int(ys.max()) + 1)[:, None]
    odd = np.zeros((len(y), len(x)), bool)
    for ax, ay, bx, by in zip(xs, ys, np.roll(xs, -1), np.roll(ys, -1), strict=True):
        if ay != by:
            odd ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    for ax, ay, bx, by in zip(xs, ys, np.roll(xs, -1), np.roll(ys, -1), strict=True):
        n = int(max(abs(bx - ax), abs(by - ay)))
        t = np.arange(n + 1) / max(n, 1)
        odd[np.floor(ay + t * (by - ay) + 0.5).astype(int) - low_y, np.floor(ax + t * (bx - ax) + 0.5).astype(int) - low_x] = True
    rows, columns = np.nonzero(odd)
    return columns + low_x, rows + low_y


_CELLS = T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))


def _fill(xs: pa.ListArray, ys: pa.ListArray, convex: bool) -> pa.ListArray:
    offsets, x, y = xs.offsets.to_numpy(), xs.values.to_numpy(), ys.values.to_numpy()
    begin, out_x, out_y = [0], [], []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        px, py = x[a:b], y[a:b]
        if convex and b > a:
            px, py = (np.array(v) for v in zip(*hull(list(zip(px.tolist(), py.tolist(), strict=True))), strict=True))
        cx, cy = covered(px, py) if b > a else (px, py)
        out_x.append(cx)
        out_y.append(cy)
        begin.append(begin[-1] + len(cx))
    flat = [pa.array(np.concatenate(v) if v else np.zeros(0), pa.int64()).cast(pa.int32()) for v in (out_x, out_y)]
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.StructArray.from_arrays(flat, names=["x", "y"]))


@F.arrow_udf(_CELLS)
def _polygon_cells(xs: pa.Array, ys: pa.Array) -> pa.Array:
    return _fill(xs, ys, False)


@F.arrow_udf(_CELLS)
def _hull_cells(xs: pa.Array, ys: pa.Array) -> pa.Array:
    return _fill(xs, ys, True)


def covered_cells(poly: Column, convex: bool = False) -> Column:
    """array<struct<x int, y int>> that a polygon covers once its vertices are rounded, or that their hull covers."""
    cells = _hull_cells if convex else _polygon_cells
    return cells(coordinates(rounded(poly), "x"), coordinates(rounded(poly), "y"))
