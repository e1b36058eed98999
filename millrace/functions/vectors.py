"""Arithmetic on arrays of numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    # no aggregate may stand within a lambda here: Spark 4.1.2 then gives wrong sums around it
    d = doubles(v)
    return F.zip_with(d, F.array_repeat(norm(v), F.size(d)), lambda x, n: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def score_from_squared(distance: Column) -> Column:
    """Similarity from the squared distance of unit vectors: 1 - d/2, and 0 beyond d = 2."""
    return F.when(distance > 2, F.lit(0.0)).otherwise(1 - distance / 2)


def score_from_distance(distance: Column) -> Column:
    """1 / (1 + d), and 0.5 where there is no distance."""
    return F.coalesce(1 / (1 + distance), F.lit(0.5))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay."""
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size == 0, 1.0, size)[:, None]
