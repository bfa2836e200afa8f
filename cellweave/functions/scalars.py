"""Scalar functions that Spark lacks, and null-safe forms of those it has."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(c: Column, low, high) -> Column:
    """c within [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low))


def normal_cdf(z: float) -> float:
    """Standard normal distribution function."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


#: Odd numbers of the series of the normal distribution function, and steps of the continued fraction of its tail.
SERIES, FRACTION, JOINT = 141, 40, 5.0


def phi(z: Column) -> Column:
    """Standard normal distribution function of a column; null for null.

    Inside +-JOINT the series 1/2 + density * (z + z^3 / 3 + z^5 / (3 * 5) + ...), beyond
    it the continued fraction of the tail; both in the JVM.
    """

    def of(v: Column) -> Column:
        square = v * v
        series = F.lit(1.0)
        for k in range(SERIES, 1, -2):
            series = 1 + square / k * series
        density = F.exp(-square / 2) / math.sqrt(2 * math.pi)
        size = F.abs(v)
        rest = size
        for k in range(FRACTION, 0, -1):
            rest = size + k / rest
        tail = density / rest
        return F.when(size < JOINT, 0.5 + density * v * series).when(v > 0, 1 - tail).otherwise(tail)

    # The transform gives the value a name, so that it is computed once.
    return F.transform(F.array(z.cast("double")), of)[0]


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, added up in order."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of the angle between two arrays; null if one is zero."""
    return 1 - ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def circularity(area: Column, perimeter: Column) -> Column:
    """4 pi area / perimeter squared."""
    return ratio(4 * math.pi * area, perimeter * perimeter)


def is_dark(red: Column, green: Column, blue: Column) -> Column:
    """Whether a colour of components in [0, 1] is dark."""
    return (0.299 * red + 0.587 * green + 0.114 * blue) < 0.5
