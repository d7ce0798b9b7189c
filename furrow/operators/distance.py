"""Exact Euclidean distances on a grid, in two separable passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.batches import whole_runs

#: Neighbouring grid rows that go to one task.
STRIP = 8


def row_minimum(row: np.ndarray, place: np.ndarray, height: np.ndarray) -> np.ndarray:
    """For each (row, place), the least (place - other)^2 + height[other]^2 in its row; infinite where no height is finite.

    Within a row the nearest other moves right as the place does, so it is found for the middle place first, and for
    either half only between its neighbours' results; all rows and halves of one level at once: n log n in all.
    Rows and places ascend.
    """
    best = np.full(len(row), np.inf)
    some = np.flatnonzero(np.isfinite(height))
    if not len(some):
        return best
    square, other = height[some] ** 2, place[some].astype(float)
    rows, first = np.unique(row, return_index=True)
    last = np.append(first[1:], len(row)) - 1
    low, high = np.searchsorted(row[some], rows), np.searchsorted(row[some], rows, "right") - 1
    has = high >= low
    first, last, low, high = first[has], last[has], low[has], high[has]
    while len(first):
        middle = (first + last) // 2
        count = high - low + 1
        begin = np.cumsum(count) - count
        at = np.repeat(low - begin, count) + np.arange(count.sum())
        cost = (np.repeat(place[middle].astype(float), count) - other[at]) ** 2 + square[at]
        least = np.minimum.reduceat(cost, begin)
        best[middle] = least
        hit = np.flatnonzero(cost == np.repeat(least, count))
        group = np.repeat(np.arange(len(count)), count)[hit]
        pick = at[hit[np.concatenate([[True], np.diff(group) > 0])]]
        left, right = first < middle, middle < last
        first, last = np.concatenate([first[left], middle[right] + 1]), np.concatenate([middle[left] - 1, last[right]])
        low, high = np.concatenate([low[left], pick[right]]), np.concatenate([pick[left], high[right]])
    return best


def distance_transform(cells: DataFrame, blocked: str = "blocked") -> DataFrame:
    """cells(x, y, blocked, …), dense, with d2, the squared distance in cells to the nearest blocked cell.

    d2 is 0 on blocked cells and null everywhere if nothing is blocked; the grid's border does not block. Distances
    along columns come from two running windows; rows then combine them, a batch of whole rows at a time, which carry
    all other columns along. One row of the grid fits a task.
    """
    up, down = (Window.partitionBy("x").orderBy(y).rowsBetween(Window.unboundedPreceding, 0) for y in (F.asc("y"), F.desc("y")))
    mark = F.when(F.col(blocked), F.col("y"))
    before, after = F.last(mark, True).over(up), F.last(mark, True).over(down)  # frames that begin at the current row are evaluated anew for each row
    near = cells.withColumn("_g", F.least(F.col("y") - before, after - F.col("y")).cast("double"))
    schema = T.StructType([*cells.schema.fields, T.StructField("d2", T.LongType())])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, "y"):
            x, y = part["x"].to_numpy(), part["y"].to_numpy()
            order = np.lexsort((x, y))
            best = np.empty(len(x))
            best[order] = row_minimum(y[order], x[order], part["_g"].fill_null(np.inf).to_numpy()[order])
            none = np.isinf(best)
            d2 = pa.array(np.where(none, 0, best).astype(np.int64), mask=none)
            yield from part.drop_columns(["_g"]).append_column("d2", d2).to_batches()

    rows = near.repartition(F.floor(F.col("y") / STRIP)).sortWithinPartitions("y")
    return rows.mapInArrow(combine, schema)


def with_distance(cells: DataFrame, resolution: float, what: str = "blocked") -> DataFrame:
    """cells with ``dist_m``, the distance in metres to the nearest cell where the column ``what`` holds."""
    found = distance_transform(cells, what)
    return found.withColumn("dist_m", F.sqrt(F.col("d2").cast("double")) * F.lit(float(resolution))).drop("d2")
