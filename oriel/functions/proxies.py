"""Daily variance proxies as Column expressions over bars (asset, ts, open, high, low, close).

All of them are daily and never annualised.  Undefined values are NULL, so that
aggregates skip them.  Returns are differences of logs; the range proxies are
logs of ratios, which keeps ``ln(1) = 0`` exact on bars without a range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

_PARKINSON = 1.0 / (4.0 * math.log(2.0))
_GARMAN_KLASS = 2.0 * math.log(2.0) - 1.0


def by_day() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("ts")


def positive(x: str | Column) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c > 0, c)


def log_ratio(a: str, b: str) -> Column:
    return F.log(positive(a) / positive(b))


def log_return(close: str = "close") -> Column:
    logged = F.log(positive(close))
    return logged - F.lag(logged).over(by_day())


def squared_return(close: str = "close") -> Column:
    return F.pow(log_return(close), F.lit(2.0))


def parkinson() -> Column:
    return F.lit(_PARKINSON) * F.pow(log_ratio("high", "low"), F.lit(2.0))


def garman_klass() -> Column:
    return F.lit(0.5) * F.pow(log_ratio("high", "low"), F.lit(2.0)) - F.lit(_GARMAN_KLASS) * F.pow(log_ratio("close", "open"), F.lit(2.0))


def rogers_satchell() -> Column:
    up = log_ratio("high", "open") * log_ratio("high", "close")
    return up + log_ratio("low", "open") * log_ratio("low", "close")


def overnight_variance() -> Column:
    return F.pow(F.log(positive("open") / F.lag(positive("close")).over(by_day())), F.lit(2.0))


def overnight_plus_range() -> Column:
    return overnight_variance() + F.when(consistent(), rogers_satchell())


PROXIES = {
    "log_return": log_return,
    "squared_return": squared_return,
    "parkinson": parkinson,
    "garman_klass": garman_klass,
    "rogers_satchell": rogers_satchell,
    "overnight_variance": overnight_variance,
    "overnight_plus_range": overnight_plus_range,
}


def consistent() -> Column:
    """low <= min(open, close) and max(open, close) <= high; false where a price is missing."""
    c = F.col  # comparisons one by one: least and greatest would pass over a missing price
    return F.coalesce((c("low") <= c("open")) & (c("low") <= c("close")) & (c("open") <= c("high")) & (c("close") <= c("high")), F.lit(False))


def violation() -> Column:
    """How far open and close reach outside the bar, relative to its bounds; infinite for bounds not above 0."""
    above = (F.greatest("open", "close") - F.col("high")) / F.col("high")
    below = (F.col("low") - F.least("open", "close")) / F.col("low")
    return F.when((F.col("high") <= 0) | (F.col("low") <= 0), F.lit(float("inf"))).otherwise(F.greatest(above, below))


def usable(x: str) -> Column:
    """A variance that can be scored or fitted on: finite and above 0."""
    c = F.col(x)
    return F.coalesce(~F.isnan(c) & (c > 0) & (c < F.lit(float("inf"))), F.lit(False))
