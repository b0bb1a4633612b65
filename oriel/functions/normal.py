"""The normal law as Column expressions.

Spark has no error function.  The distribution function is its series
1/2 + phi(z) z (1 + z^2/3 (1 + z^2/5 (...))), unrolled as nested products so that
it stays in generated code; beyond 7 standard deviations the tail expansion.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERMS, _FAR = 72, 7.0


def density(z: Column) -> Column:
    return F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def cumulative(z: Column) -> Column:
    """P(Z <= z), to about 1e-15 absolutely."""
    s, square = F.lit(1.0), z * z
    for k in range(_TERMS, 0, -1):
        s = 1.0 + square * s / (2.0 * k + 1.0)
    inverse = F.lit(1.0) / F.when(square == 0, 1.0).otherwise(square)
    tail = density(z) / F.abs(z) * (1 - inverse * (1 - 3 * inverse * (1 - 5 * inverse)))
    return F.when(F.abs(z) <= _FAR, 0.5 + density(z) * z * s).when(z > 0, 1 - tail).otherwise(tail)


def quantile_of(level: float) -> float:
    return NormalDist().inv_cdf(level)


def tail_mean_factor(level: float) -> float:
    """phi(z_a) / a: the expected shortfall of a standard normal, sign reversed."""
    return NormalDist().pdf(quantile_of(level)) / level


def crps(z: Column, sigma: Column) -> Column:
    """Continuous ranked probability score; ``z`` should be a computed column, it is used often."""
    return sigma * (z * (2 * cumulative(z) - 1) + 2 * density(z) - 1 / math.sqrt(math.pi))


def log_score(z: Column, sigma: Column) -> Column:
    return 0.5 * math.log(2 * math.pi) + F.log(sigma) + 0.5 * z * z


def value_at_risk(mu: Column, sigma: Column, level: float) -> Column:
    return mu + sigma * quantile_of(level)


def expected_shortfall(mu: Column, sigma: Column, level: float) -> Column:
    return mu - sigma * tail_mean_factor(level)
