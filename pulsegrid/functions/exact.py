"""Aggregates of fractions that do not depend on the order of rows: the same rows always give the same bits.

Each value is rounded to a decimal by itself and decimals are summed exactly, so partial sums may meet in any order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits behind the point that a value and a product of two values keep.
KIND = "decimal(38,12)"


def exact_sum(x: Column) -> Column:
    return F.sum(x.cast("double").cast(KIND)).cast("double")


def exact_avg(x: Column) -> Column:
    return F.when(F.count(x) > 0, exact_sum(x) / F.count(x))


def exact_stddev(x: Column) -> Column:
    """The sample deviation; null for fewer than two values."""
    x = x.cast("double")
    n = F.count(x).cast("double")
    spread = exact_sum(x * x) - exact_sum(x) * exact_sum(x) / n
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1)))


def exact_slope(y: Column, x: Column) -> Column:
    """The least-squares slope of y over x, of rows that have both; null where x does not vary."""
    both = y.isNotNull() & x.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(a).cast("double")
    sxx, sxy = exact_sum(a * a) - exact_sum(a) * exact_sum(a) / n, exact_sum(a * b) - exact_sum(a) * exact_sum(b) / n
    return F.when((n > 1) & (sxx > 0), sxy / sxx)
