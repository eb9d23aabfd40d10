"""Statistics of 2x2 tables and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Odds ratio with one half added to every cell."""
    return ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5))


def chi2_yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of a 2x2 table with continuity correction; 0 if a margin is empty.

    All four cells deviate equally from their expectation; the correction takes
    off one half, but no more than the deviation.
    """
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n, r1, r2, k1, k2 = a + b + c + d, a + b, c + d, a + c, b + d
    dev = F.abs(a - r1 * k1 / n)
    dev = dev - F.least(F.lit(0.5), dev)
    chi = dev * dev * n * n * n / (r1 * r2 * k1 * k2)
    return F.when((r1 == 0) | (r2 == 0) | (k1 == 0) | (k2 == 0), 0.0).otherwise(chi)


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0, without Python.

    Below 3 one minus the series exp(-z^2) * sum of 2^n z^(2n+1) / (2n+1)!!,
    from 3 on the continued fraction, evaluated from its end.
    """
    root_pi = F.lit(math.sqrt(math.pi))
    grow = lambda a, n: F.struct((a["term"] * 2 * z * z / (2 * n + 1)).alias("term"), (a["sum"] + a["term"] * 2 * z * z / (2 * n + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(z.alias("term"), z.alias("sum")), grow, lambda a: a["sum"])
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(1.0), lambda a, k: 1 + k / (2 * z * z) / a)
    return F.when(z < 3, 1 - 2 / root_pi * F.exp(-z * z) * series).otherwise(F.exp(-z * z) / (z * root_pi * tail))


def chi2_p(chi2: Column | str) -> Column:
    """Upper tail of chi-square with one degree of freedom; null for null."""
    c = F.col(chi2) if isinstance(chi2, str) else chi2
    return erfc(F.sqrt(c / 2))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
