"""Numeric helpers on columns and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(x: Column) -> Column:
    """Of an array of doubles, shifted by its largest so that nothing overflows."""
    shifted = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(shifted, lambda v: v / total)


def one_hot(value: Column, classes: list) -> Column:
    """An array with 1.0 at the value's place in ``classes``; all 0.0 for other values and null."""
    return F.array(*[F.coalesce((value == F.lit(c)).cast("double"), F.lit(0.0)) for c in classes])


def index_range(x: Column) -> Column:
    """(least, most) of an array of numbers, -1 for both where it is empty or null."""
    return F.struct(F.coalesce(F.array_min(x), F.lit(-1)).alias("least"), F.coalesce(F.array_max(x), F.lit(-1)).alias("most"))
