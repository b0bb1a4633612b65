"""Special functions in plain numpy and math, for block models and distributions."""

from __future__ import annotations

import math

import numpy as np


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-square for 1 or 2 degrees of freedom."""
    if df == 1:
        return math.erfc(math.sqrt(max(x, 0.0) / 2))
    if df == 2:
        return math.exp(-max(x, 0.0) / 2)
    raise ValueError("1 or 2 degrees of freedom")


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return f


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(x: float, df: float) -> float:
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + x * x)) if math.isfinite(x) else 0.0
    return 1 - half if x > 0 else half


def t_pdf(x: float, df: float) -> float:
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * math.log1p(x * x / df))


def t_ppf(p: float, df: float) -> float:
    """Quantile by bisection in a bracket, then Newton steps."""
    if p == 0.5:
        return 0.0
    if p > 0.5:
        return -t_ppf(1 - p, df)
    low, high = -1.0, 0.0
    while t_cdf(low, df) > p:
        low, high = 2 * low, low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    x = (low + high) / 2
    for _ in range(3):
        d = t_pdf(x, df)
        x -= (t_cdf(x, df) - p) / d if d > 0 else 0
    return x


def beta_ln(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def gauss_legendre(n: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on (0, 1)."""
    x, w = np.polynomial.legendre.leggauss(n)
    return (x + 1) / 2, w / 2
