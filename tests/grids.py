"""Small grids and aisles for the tests."""

import numpy as np

UNKNOWN, FREE, OCCUPIED = 205, 254, 0


def grid(spark, array, column, candidate=None):
    a = np.asarray(array)
    rows = [(int(x), int(y), int(a[y, x])) + (() if candidate is None else (bool(candidate[y, x]),)) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, f"x int, y int, {column} int" + ("" if candidate is None else ", is_candidate boolean"))


def rect(x0, y0, x1, y1):
    return [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]


def aisles(spark, *polygons, sizes=None):
    rows = [(k + 1, None, p, *(sizes[k] if sizes else (None, None))) for k, p in enumerate(polygons)]
    return spark.createDataFrame(rows, "aisle_id int, label string, polygon array<struct<x:double,y:double>>, width_m double, length_m double")


def area(height, width, fill, **boxes):
    """A grid filled with one value; boxes are (y0, y1, x0, x1, value), ends excluded."""
    a = np.full((height, width), fill)
    for y0, y1, x0, x1, value in boxes.values():
        a[y0:y1, x0:x1] = value
    return a


FOOTPRINT = [(0.30, 0.20), (0.30, -0.20), (-0.30, -0.20), (-0.30, 0.20)]
