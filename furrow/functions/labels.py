"""Connected components in numpy, for edges and cells that fit a task."""

from __future__ import annotations

import numpy as np


def components_of(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component; edges run from ``a`` to ``b``."""
    label = np.arange(nodes)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # roots hang below smaller roots
        while (label[label] != label).any():
            label = label[label]
    return label


def label_cells(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For distinct cells, the index of the least cell (by row, then column) of those that sides connect with each.

    Cells of a row form runs, and runs of neighbouring rows touch where their columns overlap.
    """
    if not len(x):
        return np.zeros(0, np.int64)
    x, y = x.astype(np.int64), y.astype(np.int64)
    x, y = x - x.min(), y - y.min()
    wide = int(x.max()) + 2
    order = np.argsort(y * wide + x, kind="stable")
    place = (y * wide + x)[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(place) != 1]))  # a column is left free between rows
    last = np.append(first[1:], len(place)) - 1
    start, end = place[first], place[last]
    low, high = np.searchsorted(end, start + wide), np.searchsorted(start, end + wide, "right")
    count = np.maximum(high - low, 0)
    below = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    run = components_of(len(first), np.repeat(np.arange(len(first)), count), below)
    out = np.empty(len(x), np.int64)
    out[order] = np.repeat(order[first][run], last - first + 1)
    return out
