"""Connected components: of edge tables by star contraction, of grid cells by tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.labels import components_of, label_cells
from furrow.storage import materialise

#: So many edges are joined in one task; more go through rounds of joins. The result is the same.
FEW_EDGES = 1 << 20
#: Cells to a side of a tile.
TILE = 256


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(u, v) pointing each node of at most ``FEW_EDGES`` edges(u, v) at the least one of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        u, v = (np.concatenate(p) for p in zip(*parts, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = components_of(len(nodes), at[: len(u)], at[len(u) :])
        below = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[label[below]])], names=["u", "v"])

    return edges.coalesce(1).mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a long, b long); a component is its smallest node.

    Alternating star contractions (Kiveris et al., 2014): every round points nodes at smaller neighbours, halving
    distances, until each component is a star. Rounds are written to the shared folder; only row counts and a checksum
    reach the driver. Nodes with many edges meet in partial minima and in joins that adaptive execution can split.
    A table of ``FEW_EDGES`` at most is a task's work and takes no rounds.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = materialise(edges, "edges")
    if edges.count() <= FEW_EDGES:
        edges = materialise(_in_one_task(edges), "edges")
    else:
        edges = _contracted(edges)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v) pointing each node of edges(u, v), u > v, at the least one of its component, by rounds of joins."""
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).withColumn("least", F.least("u", "least"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u > v").distinct()
        small = large.join(_least(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
        edges = materialise(small.where("u > v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before or not now["n"]:
            return edges
        before = now


def _id(x: Column, y: Column) -> Column:
    return y.cast("long") * (1 << 32) + x.cast("long")


def grid_components(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """cells(x, y) that touch along sides: (x, y, component), the component being its least cell's number (y, then x).

    Every tile of the grid is labelled in one pass; then only cells along the tiles' borders are linked, and components
    are found over tiles' regions, of which there are far fewer than cells.
    """
    cells = cells.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()
    cells = cells.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})

    def label(_, part):
        x, y = part["x"].to_numpy(), part["y"].to_numpy()
        least = label_cells(x, y)
        region = y[least].astype(np.int64) * (1 << 32) + x[least]
        return pa.table({"x": part["x"], "y": part["y"], "region": region})

    marked = materialise(cells.groupBy("tx", "ty").applyInArrow(label, "x int, y int, region long"), "regions")
    touching = []
    for axis in "xy":
        low = marked.where(F.pmod(F.col(axis), F.lit(tile)) == 0).withColumn(axis, F.col(axis) - 1).withColumnRenamed("region", "b")
        high = marked.where(F.pmod(F.col(axis), F.lit(tile)) == tile - 1).withColumnRenamed("region", "a")
        touching.append(high.join(low, ["x", "y"]).select("a", "b"))
    found = connected_components(touching[0].unionByName(touching[1]))
    return marked.join(found, marked["region"] == found["node"], "left").select("x", "y", F.coalesce("component", "region").alias("component"))


def large_components(components: DataFrame, least: int) -> DataFrame:
    """The cells of components of ``least`` cells or more."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return components.join(sizes, "component")
