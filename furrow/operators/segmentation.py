"""Ground segmentation of one point cloud: points(x, y, z, …) gain ``is_ground``; either half is a filter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rows the built-in exact percentile is one aggregation; beyond, ranges are narrowed first.
SMALL = 1_000_000
BINS = 4096


def exact_percentile(df: DataFrame, column: str, fraction: float, small: int = SMALL) -> float | None:
    """The percentile by linear interpolation of neighbours, as an exact number.

    Null and NaN do not count; infinite values rank at the ends. Beyond ``small`` values each pass counts them in equal
    bins (at most ``BINS`` counts reach the driver) and goes on with the bin that holds both neighbours, until the
    built-in aggregate can finish; memory stays bounded at any size.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    infinite = F.col("v").isin(float("inf"), float("-inf"))
    finite = F.when(~infinite, F.col("v"))
    n, least, most, low, high = values.agg(F.count("v"), F.count_if(infinite & (F.col("v") < 0)), F.count_if(infinite & (F.col("v") > 0)), F.min(finite), F.max(finite)).first()
    if not n:
        return None
    at = fraction * (n - 1)
    first, second = int(at), min(int(at) + 1, n - 1)
    inner = n - least - most
    a, b = (float("-inf") if r < least else float("inf") if r >= least + inner else None for r in (first, second))
    if a is None or b is None:
        x, y = _neighbours(values.where(~infinite), max(first - least, 0), min(second - least, inner - 1), inner, low, high, small)
        a, b = x if a is None else a, y if b is None else b
    return a if a == b or at == first else a + (b - a) * (at - first)


def _neighbours(values: DataFrame, first: int, second: int, n: int, low: float, high: float, small: int) -> tuple[float, float]:
    """The values of two ranks, equal or next to each other, among ``n`` finite values from ``low`` to ``high``.

    A pass always leaves something out, as the least and the most fall in different bins.
    """
    while n > small and low < high:
        width = high / BINS - low / BINS
        if not width:  # values too close for bins
            break
        bins = values.groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)).alias("k"))
        bins = sorted(bins.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect())
        k = 0
        while first >= bins[k]["n"]:
            first, second = first - bins[k]["n"], second - bins[k]["n"]
            k += 1
        if second >= bins[k]["n"]:
            return bins[k]["high"], bins[k + 1]["low"]
        n, low, high = bins[k]["n"], bins[k]["low"], bins[k]["high"]
        values = values.where(F.col("v").between(low, high))
    if low == high:
        return low, low
    # the least value whose share of values up to it reaches half a value beyond the rank is that rank's, exactly
    ranks = [F.expr(f"percentile_disc({(r + 0.5) / n!r}) within group (order by v)") for r in (first, second)]
    return tuple(values.agg(*ranks).first())


def _level(points: DataFrame, fraction: float) -> Column:
    """The percentile as a literal of z's own type, as single precision stays single."""
    return F.lit(exact_percentile(points, "z", fraction)).cast(dict(points.dtypes)["z"])


def _limit(points: DataFrame, level: Column, height: float) -> Column:
    kind = dict(points.dtypes)["z"]
    return (level + F.lit(height).cast(kind)).cast(kind)


def near_level(points: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Ground lies within ``threshold`` of the 10th percentile, on either side."""
    kind = dict(points.dtypes)["z"]
    return points.withColumn("is_ground", F.coalesce(F.abs(F.col("z") - _level(points, 0.1)) < F.lit(threshold).cast(kind), F.lit(False)))


def voxel_ground(points: DataFrame, voxel_size: float = 0.2) -> DataFrame:
    """The same as ``near_level``; the voxel size is accepted and has no effect."""
    return near_level(points)


def height_threshold(points: DataFrame, config: dict | None = None) -> DataFrame:
    """Ground lies below the 10th percentile plus ``height_threshold`` (0.15)."""
    limit = _limit(points, _level(points, 0.1), float((config or {}).get("height_threshold", 0.15)))
    return points.withColumn("is_ground", F.coalesce(F.col("z") < limit, F.lit(False)))


def histogram(points: DataFrame, bins: int = 200, column: str = "z") -> DataFrame:
    """(bin, left_edge, n) of the bins that hold values: equal widths from least to most, the last closed.

    Equal values all over widen the range by a half on either side.
    """
    values = points.select(F.col(column).cast("double").alias("v")).where("v is not null")
    span = values.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    span = span.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))

    def edge(k: Column) -> Column:
        return F.when(k == bins, F.col("hi")).otherwise(F.col("lo") + k * ((F.col("hi") - F.col("lo")) / bins))

    k = F.least(F.floor((F.col("v") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))), F.lit(bins - 1))
    placed = values.crossJoin(F.broadcast(span)).withColumn("k", k)  # one row of two numbers
    exact = F.when(F.col("v") < edge(F.col("k")), F.col("k") - 1).when((F.col("k") < bins - 1) & (F.col("v") >= edge(F.col("k") + 1)), F.col("k") + 1).otherwise(F.col("k"))
    placed = placed.withColumn("bin", exact.cast("int"))
    return placed.groupBy("bin", edge(F.col("bin")).alias("left_edge")).agg(F.count(F.lit(1)).alias("n"))


def histogram_mode(points: DataFrame, config: dict | None = None) -> DataFrame:
    """Ground lies below the left edge of the first fullest of ``bins`` (200) plus ``height_threshold`` (0.25)."""
    config = config or {}
    mode = histogram(points, int(config.get("bins", 200))).orderBy(F.desc("n"), "bin").limit(1).select(F.col("left_edge").cast(dict(points.dtypes)["z"]).alias("_level"))
    limit = _limit(points, F.col("_level"), float(config.get("height_threshold", 0.25)))
    return points.join(F.broadcast(mode), how="left").withColumn("is_ground", F.coalesce(F.col("z") < limit, F.lit(False))).drop("_level")  # one row


Algorithm = Callable[[DataFrame, dict | None], DataFrame]
_algorithms: dict[str, Algorithm] = {}


def register_algorithm(name: str) -> Callable[[Algorithm], Algorithm]:
    def keep(algorithm: Algorithm) -> Algorithm:
        _algorithms[name] = algorithm
        return algorithm

    return keep


def get_algorithm(name: str) -> Algorithm:
    try:
        return _algorithms[name]
    except KeyError:
        raise KeyError(f"no segmentation algorithm {name!r}; there are {', '.join(list_algorithms())}") from None


def list_algorithms() -> list[str]:
    return sorted(_algorithms)


register_algorithm("height_threshold")(height_threshold)
register_algorithm("morphological_pmf")(histogram_mode)


def segment(points: DataFrame, algorithm: str = "height_threshold", config: dict | None = None) -> DataFrame:
    """points with ``is_ground`` and the algorithm's name."""
    return get_algorithm(algorithm)(points, config).withColumn("algorithm", F.lit(algorithm))
