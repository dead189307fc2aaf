"""Special functions as column expressions, without Python per row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series below SPLIT, and of the continued fraction from it on: both are then right to about 1e-14, relative above 1e-3.
_TERMS, _SPLIT = 60, 3.0


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0: one less a series of erf for small x, a continued fraction for large x; null of null and NaN."""
    x = F.when(~F.isnan(x), x)
    # erf(x) = 2/sqrt(pi) e^(-x^2) sum of x (2 x^2)^n / (1 3 5 ... (2n + 1))
    start = F.struct(x.alias("term"), x.alias("sum"))
    step = lambda s, n: F.struct((s["term"] * 2 * x * x / (2 * n + 1)).alias("term"), (s["sum"] + s["term"] * 2 * x * x / (2 * n + 1)).alias("sum"))
    series = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), start, step)["sum"]
    # erfc(x) = e^(-x^2) / sqrt(pi) / (x + 1/2 / (x + 1 / (x + 3/2 / (x + ...))))
    fraction = F.aggregate(F.sequence(F.lit(_TERMS), F.lit(1), F.lit(-1)), x, lambda s, n: x + n / 2 / s)
    return F.when(x < _SPLIT, series).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / F.greatest(fraction, F.lit(1.0)))


def digamma(x: Column) -> Column:
    """The logarithmic derivative of the gamma function of x > 0: moved up by six, then its asymptotic series; right to about 1e-10."""
    z = x + 6
    square = 1 / (z * z)
    series = F.ln(z) - 1 / (2 * z) - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132))))
    return series - sum((1 / (x + k) for k in range(1, 6)), 1 / x)


def trigamma(x: Column) -> Column:
    """The derivative of `digamma` for x > 0, likewise."""
    z = x + 6
    square = 1 / (z * z)
    series = 1 / z + square / 2 + square / z * (1 / 6 - square * (1 / 30 - square * (1 / 42 - square * (1 / 30 - square * 5 / 66))))
    return series + sum((1 / (x + k) ** 2 for k in range(1, 6)), 1 / (x * x))
