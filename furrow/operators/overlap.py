"""What areas on a grid cover: each area goes to the tile of the map that its corner lies in, and is reduced there.

The map is cut into square tiles with a margin as wide as the largest area, so that an area never needs a second tile.
Only areas and map cells are shuffled, once each; the cells that areas cover are never rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.geometry import coordinates, rounded
from furrow.functions.raster import covered, hull

#: Cells to a side of a tile, at least; covered cells that are looked at together.
TILE, CELLS = 128, 1 << 21
#: Fixed values of the map.
OCCUPIED, UNKNOWN, NONE = 0, 205, 255

RESULTS = {"cells": "long", "occupied": "long", "unknown": "long", "candidates": "long", "near_m": "double", "p10_m": "double"}


def _tenth(dist: np.ndarray) -> np.ndarray:
    """The 10th percentile of each row's numbers by linear interpolation; NaN counts as none."""
    have = np.sum(~np.isnan(dist), axis=1)
    ranked = np.sort(dist, axis=1)  # NaN last
    at = np.maximum(have - 1, 0) * 0.1
    low = np.floor(at).astype(int)
    rows = np.arange(len(dist))
    a, b = ranked[rows, low], ranked[rows, np.minimum(low + 1, np.maximum(have - 1, 0))]
    return np.where(have > 0, a + (b - a) * (at - low), np.nan)


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of whole numbers from 0 on, and which of them each row is."""
    base, bound, code = int(rows.max()) + 1, 1, np.zeros(len(rows), np.int64)
    for column in rows.T:
        if bound * base >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            bound = int(code.max()) + 1
        code = code * base + column
        bound *= base
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    return rows[first], which


def _reduced(xs: np.ndarray, ys: np.ndarray, origin: tuple[int, int], base: np.ndarray, candidate: np.ndarray, dist: np.ndarray, convex: bool, results: dict[str, str]) -> dict[str, np.ndarray]:
    """``results`` of areas with vertices (xs, ys) on a tile's arrays; areas of one shape are looked at together."""
    count = len(xs)
    out = {k: np.zeros(count, np.int64 if kind == "long" else float) for k, kind in results.items()}
    x0, y0 = xs.min(axis=1), ys.min(axis=1)
    shapes, which = distinct_rows(np.concatenate([xs - x0[:, None], ys - y0[:, None]], axis=1))
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(len(shapes) + 1))
    for k, shape in enumerate(shapes):
        px, py = np.split(shape, 2)
        if convex:
            px, py = (np.array(v) for v in zip(*hull(list(zip(px.tolist(), py.tolist(), strict=True))), strict=True))
        dx, dy = covered(px, py)
        own = order[cuts[k] : cuts[k + 1]]
        step = max(1, CELLS // len(dx))
        for a in range(0, len(own), step):
            at = own[a : a + step]
            cell = (y0[at] - origin[1])[:, None] + dy, (x0[at] - origin[0])[:, None] + dx
            value, near = base[cell], dist[cell]
            out["cells"][at] = (value != NONE).sum(axis=1)
            out["occupied"][at] = (value == OCCUPIED).sum(axis=1)
            out["unknown"][at] = (value == UNKNOWN).sum(axis=1)
            out["candidates"][at] = candidate[cell].sum(axis=1)
            least = np.where(np.isnan(near), np.inf, near).min(axis=1)
            out["near_m"][at] = np.where(np.isinf(least), np.nan, least)
            if "p10_m" in out:
                out["p10_m"][at] = _tenth(near)
    return out


def overlap(areas: DataFrame, area: str, grid: DataFrame, reach_cells: float, convex: bool = False, percentile: bool = True) -> DataFrame:
    """areas without the column ``area`` (a polygon in cells), with what the cells that it covers hold.

    ``cells`` counts those on the map; ``occupied``, ``unknown`` and ``candidates`` are counts, ``near_m`` and ``p10_m``
    the least and, with ``percentile``, the 10th percentile of ``dist_m``, null without any. grid is (x, y, base, is_candidate, dist_m). An
    area, or with ``convex`` its hull, is taken with its vertices rounded; none spans more than ``reach_cells``. The
    areas of a tile fit a task: they are as many as routes cross it.
    """
    span = math.ceil(reach_cells) + 2
    side = max(TILE, 2 * span)
    session = areas.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    results = {k: kind for k, kind in RESULTS.items() if percentile or k != "p10_m"}
    whole = rounded(F.col(area))
    placed = areas.withColumns({f"_{a}s": F.transform(coordinates(whole, a), lambda v: v.cast("int")) for a in "xy"}).drop(area)
    placed = placed.withColumns({f"_t{a}": F.floor(F.array_min(f"_{a}s") / side) for a in "xy"})
    keep = [f for f in areas.schema.fields if f.name != area]
    schema = T.StructType([*keep, *[T.StructField(k, T.LongType() if kind == "long" else T.DoubleType()) for k, kind in results.items()]])
    cells = grid.select("x", "y", "base", "is_candidate", "dist_m")
    for a in "xy":
        tiles = F.array_distinct(F.array(F.floor(F.col(a) / side), F.floor((F.col(a) - span) / side)))
        cells = cells.withColumn(f"_t{a}", F.explode(tiles))

    def reduce(key, left, right):
        names = [f.name for f in keep]
        if not left.num_rows:
            empty = {k: pa.array([], pa.int64() if kind == "long" else pa.float64()) for k, kind in results.items()}
            return pa.table([*left.select(names).columns, *empty.values()], names=[*names, *empty])
        origin = key[0].as_py() * side, key[1].as_py() * side
        shape = side + span + 1, side + span + 1
        base, candidate, dist = np.full(shape, NONE, np.uint8), np.zeros(shape, bool), np.full(shape, np.nan)
        at = right["y"].to_numpy() - origin[1], right["x"].to_numpy() - origin[0]
        base[at] = right["base"].to_numpy()
        candidate[at] = right["is_candidate"].fill_null(False).to_numpy()
        dist[at] = right["dist_m"].fill_null(np.nan).to_numpy()
        xs, ys = (np.stack(left[f"_{a}s"].combine_chunks().flatten().to_numpy().reshape(left.num_rows, -1)) for a in "xy")
        if max(np.ptp(xs, axis=1).max(), np.ptp(ys, axis=1).max()) > span:
            raise ValueError("an area spans more cells than its tile's margin")
        found = _reduced(xs.astype(np.int64), ys.astype(np.int64), origin, base, candidate, dist, convex, results)
        columns = [pa.array(v) if v.dtype == np.int64 else pa.array(v, mask=np.isnan(v)) for v in found.values()]
        return pa.table([*left.select(names).columns, *columns], names=[*names, *found])

    # a number of partitions, as adaptive execution would put small tables into one task; the work is in Python
    both = [df.repartition(parts, "_tx", "_ty").groupBy("_tx", "_ty") for df in (placed, cells)]
    return both[0].cogroup(both[1]).applyInArrow(reduce, schema)
