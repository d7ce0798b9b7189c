"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def linspace(start: Column, stop: Column, count: Column) -> Column:
    """``count`` evenly spaced numbers from start to stop, both included; one number is start."""
    count = count.cast("int")
    step = (stop - start) / F.greatest(count - 1, F.lit(1))
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.when((i == count - 1) & (count > 1), stop).otherwise(start + i.cast("double") * step)
    )


def rounded_cell(value: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.rint(value).cast("int")


def steps_within(step: float, low: Column, high: Column) -> Column:
    """All non-zero multiples of ``step`` between low and high, with a tolerance of 1e-12."""
    up = F.floor((high + 1e-12) / step)
    down = F.floor((1e-12 - low) / step)
    none = F.array().cast("array<double>")
    rising = F.when(up >= 1, F.transform(F.sequence(F.lit(1).cast("long"), up), lambda k: k.cast("double") * step)).otherwise(none)
    falling = F.when(down >= 1, F.transform(F.sequence(F.lit(1).cast("long"), down), lambda k: -(k.cast("double") * step))).otherwise(none)
    return F.concat(rising, falling)


def distinct_within(values: Column, tolerance: float = 1e-9) -> Column:
    """Ascending values, each more than ``tolerance`` above the one kept before it."""
    return F.aggregate(
        F.array_sort(values),
        F.array().cast("array<double>"),
        lambda kept, v: F.when((F.size(kept) == 0) | (v - F.element_at(kept, -1) > tolerance), F.concat(kept, F.array(v))).otherwise(kept),
    )


def largest_step(values: Column) -> Column:
    """The largest absolute difference of neighbours; 0 for fewer than two."""
    pairs = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda a, b: F.abs(b - a))
    return F.when(F.size(values) < 2, F.lit(0.0)).otherwise(F.array_max(pairs))


def numbered_label(prefix: str, number: Column) -> Column:
    """Labels like A07."""
    return F.format_string(prefix + "%02d", number)
