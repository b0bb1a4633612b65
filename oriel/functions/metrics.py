"""Losses and hit indicators; NULL wherever an input is missing or outside the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = (0.01, 0.025, 0.05)
#: Assets that trade every day of the year.
DAILY = ("BTC-USD", "ETH-USD")


def level_tag(level: float) -> str:
    return f"{level:.10g}".replace(".", "p").replace("-", "m")


def qlike(forecast: Column, proxy: Column) -> Column:
    """p/f - ln(p/f) - 1 for a variance forecast f and a proxy p, both above 0."""
    ratio = F.when((forecast > 0) & (proxy > 0), proxy / forecast)
    return ratio - F.log(ratio) - 1


def squared_error(forecast: Column, proxy: Column) -> Column:
    return F.pow(forecast - proxy, F.lit(2.0))


def pinball(y: Column, q: Column, level: float) -> Column:
    u = y - q
    return F.when(u >= 0, level * u).otherwise((level - 1) * u)


def hit(y: Column, var: Column) -> Column:
    """1 where the return is strictly below the quantile."""
    return F.when(y.isNotNull() & var.isNotNull(), (y < var).cast("double"))


def fz0(y: Column, var: Column, es: Column, level: float, strict: bool = True) -> Column:
    """Joint loss of quantile and expected shortfall, for es < 0 and es <= var; NULL where an input is.

    Forecasts outside that domain have no loss: an error, or NULL if not ``strict``.
    """
    ok = (es < 0) & (es <= var)
    short = F.when(y <= var, var - y).otherwise(0.0)
    loss = F.when(ok & y.isNotNull(), -short / (level * F.when(ok, es)) + var / F.when(ok, es) + F.log(-F.when(ok, es)) - 1)
    if not strict:
        return loss
    return F.when(~ok & y.isNotNull(), F.raise_error(F.lit("expected shortfall must be below 0 and not above the quantile")).cast("double")).otherwise(loss)


def periods_per_year(asset: Column) -> Column:
    return F.when(asset.isin(*DAILY), 365.0).otherwise(252.0)


def x_log_y(x: Column, y: Column) -> Column:
    """x ln y with 0 ln 0 = 0."""
    return F.when(x == 0, 0.0).otherwise(x * F.log(F.when(y > 0, y)))
