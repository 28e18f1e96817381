"""Moment-based statistics as aggregate expressions.

Spark's ``skewness`` and ``kurtosis`` are the biased g1 and g2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fewest values the normality test is defined for.
NORMALITY_MIN_ROWS = 8


def corrected_skewness(c: Column) -> Column:
    """Sample skewness G1; 0 for a constant column, null below 3 values."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return (
        F.when(n < 3, F.lit(None))
        .when(F.min(c) == F.max(c), F.lit(0.0))
        .otherwise(F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * g1)
    )


def corrected_kurtosis(c: Column) -> Column:
    """Sample excess kurtosis G2; 0 for a constant column, null below 4 values."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    denominator = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return (
        F.when(n < 4, F.lit(None))
        .when(F.min(c) == F.max(c), F.lit(0.0))
        .otherwise((n - 1) / denominator * ((n + 1) * g2 + 6))
    )


def variation(c: Column) -> Column:
    """Standard deviation over mean, null where the mean is 0."""
    return F.try_divide(F.stddev_samp(c), F.nullif(F.avg(c), F.lit(0.0)))


def skew_score(n: Column, g1: Column) -> Column:
    """Normal score of the skewness (D'Agostino's transformation)."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    y = F.when(y == 0, F.lit(1.0)).otherwise(y)
    beta = (
        3
        * (n * n + 27 * n - 70)
        * (n + 1)
        * (n + 3)
        / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    )
    w2 = F.sqrt(2 * (beta - 1)) - 1
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2 / (w2 - 1))
    return delta * F.asinh(y / alpha)


def kurtosis_score(n: Column, g2: Column) -> Column:
    """Normal score of the excess kurtosis (Anscombe and Glynn's transformation)."""
    b2 = g2 + 3
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - mean) / F.sqrt(var)
    root_b1 = (
        6
        * (n * n - 5 * n + 2)
        / ((n + 7) * (n + 9))
        * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = 6 + 8 / root_b1 * (2 / root_b1 + F.sqrt(1 + 4 / (root_b1 * root_b1)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    ratio = F.try_divide(1 - 2 / a, F.abs(d))
    term = F.signum(d) * F.pow(ratio, F.lit(1.0 / 3.0))
    return (1 - 2 / (9 * a) - term) / F.sqrt(2 / (9 * a))


def normality(n: Column, g1: Column, g2: Column) -> tuple[Column, Column]:
    """Statistic and p-value of the omnibus K² test from n, g1 and g2 columns."""
    n = F.when(n >= NORMALITY_MIN_ROWS, n.cast("double"))
    z1 = skew_score(n, g1)
    z2 = kurtosis_score(n, g2)
    k2 = z1 * z1 + z2 * z2
    return k2, F.exp(-k2 / 2)
