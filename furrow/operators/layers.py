"""Semantic labels and aisles composed into a three-valued navigation map: cells(x, y, base, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.numbers import numbered_label
from furrow.functions.raster import covered_cells
from furrow.storage import spread

#: Fixed values of the map image.
OCCUPIED, UNKNOWN, FREE = 0, 205, 254
#: Fixed semantic labels: ridge, wall, pillar; obstacle and step candidates; free ground.
HARD, CANDIDATE, PILLAR, GROUND = (2, 4, 6), (3, 5), (6,), 1


def aisle_cells(aisles: DataFrame, *more: str) -> DataFrame:
    """(aisle_id, x, y, more…) of the cells that each aisle's rounded polygon covers."""
    cells = spread(aisles, "aisle_id").select("aisle_id", *more, F.explode(covered_cells(F.col("polygon"))).alias("c"))
    return cells.select("aisle_id", "c.x", "c.y", *more)


def labelled(aisles: DataFrame) -> DataFrame:
    """aisles with the default label A07 where there is none."""
    return aisles.withColumn("label", F.coalesce("label", numbered_label("A", F.col("aisle_id"))))


def navigation_layers(semantic: DataFrame, aisles: DataFrame) -> DataFrame:
    """semantic(x, y, label) with is_hard, is_candidate, is_pillar, is_aisle and base.

    Hard structure is occupied whatever covers it; free ground and aisles are free; all else is unknown.
    """
    inside = aisle_cells(aisles).select("x", "y").distinct().withColumn("_in", F.lit(True))
    # the planner, which sees the aisles' size, would broadcast their cells, and in a cached plan nothing corrects it
    cells = semantic.join(inside.hint("merge"), ["x", "y"], "left").withColumn("is_aisle", F.coalesce("_in", F.lit(False))).drop("_in")
    label = F.col("label")
    cells = cells.withColumns({"is_hard": label.isin(*HARD), "is_candidate": label.isin(*CANDIDATE), "is_pillar": label.isin(*PILLAR)})
    base = F.when(F.col("is_hard"), OCCUPIED).when((label == GROUND) | F.col("is_aisle"), FREE).otherwise(UNKNOWN)
    return cells.withColumn("base", base)


def layer_counts(layers: DataFrame) -> DataFrame:
    """One row of cell counts, and whether static obstacles stayed obstacles."""

    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    free = F.col("base") == FREE
    return layers.agg(
        count(F.col("is_candidate"), "candidate_cell_count"),
        count(F.col("is_hard"), "hard_obstacle_cell_count"),
        count(F.col("is_hard") & free, "hard_obstacle_as_free_cell_count"),
        count(F.col("is_pillar"), "pillar_cell_count"),
        count(F.col("is_pillar") & free, "pillar_as_free_cell_count"),
        count(free, "free_cell_count"),
        count(F.col("base") == UNKNOWN, "unknown_cell_count"),
        count(F.col("base") == OCCUPIED, "occupied_cell_count"),
    ).withColumn("static_obstacle_semantics_valid", F.col("hard_obstacle_as_free_cell_count") == 0)


def gray_semantics(cells: DataFrame) -> DataFrame:
    """One row: the map's values in order, those outside the three known ones, and whether there are none."""
    values = cells.agg(F.array_sort(F.collect_set("base")).alias("observed_gray_values"))
    values = values.withColumn("unexpected_gray_values", F.array_except("observed_gray_values", F.array(*map(F.lit, (OCCUPIED, UNKNOWN, FREE)))))
    return values.withColumn("gray_semantics_valid", F.size("unexpected_gray_values") == 0)


def map_metadata(image: str, resolution: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> dict:
    """The map server's description of an image."""
    return {"image": image, "mode": "trinary", "resolution": float(resolution), "origin": [float(v) for v in origin], "negate": 0, "occupied_thresh": 0.65, "free_thresh": 0.196}


def metadata_valid(metadata: dict) -> bool:
    return metadata["mode"] == "trinary" and 0.0 <= metadata["free_thresh"] < metadata["occupied_thresh"] <= 1.0


def blocked(base: Column, allow_unknown: bool = False) -> Column:
    """Occupied cells, and unknown ones unless they are allowed."""
    return base == OCCUPIED if allow_unknown else (base == OCCUPIED) | (base == UNKNOWN)
