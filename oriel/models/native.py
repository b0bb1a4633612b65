"""Models that are window expressions: trailing volatility, exponential weights, and autoregressive features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.positions import by_pos


def trailing_variance(ret: str, window: int) -> Column:
    """Mean square of the last ``window`` returns, at least 1e-24."""
    frame = by_pos().rowsBetween(-(window - 1), 0)
    square = F.pow(F.col(ret), F.lit(2.0))
    return F.when(F.count(ret).over(frame) == window, F.greatest(F.avg(square).over(frame), F.lit(1e-24)))


def weighted_variance(ret: str, window: int, decay: float = 0.94) -> Column:
    """Exponentially weighted recursion through the window, started at its first squared return.

    Unrolled it is a weighted sum, but the start moves with the window, so it is
    a fold over the frame's array: no state crosses rows, any row can be computed anywhere.
    """
    frame = by_pos().rowsBetween(-(window - 1), 0)
    square = F.collect_list(F.pow(F.col(ret), F.lit(2.0))).over(frame)
    folded = F.aggregate(F.slice(square, 2, window), F.element_at(square, 1), lambda v, x: decay * v + (1 - decay) * x)
    return F.when(F.count(ret).over(frame) == window, F.greatest(folded, F.lit(1e-24)))


def har_features(rows: DataFrame, variance: str) -> DataFrame:
    """Yesterday's variance and its means over 5 and 22 days; NULL until the frame is full."""
    mean = lambda n: F.when(F.count(variance).over(by_pos().rowsBetween(-(n - 1), 0)) == n, F.avg(variance).over(by_pos().rowsBetween(-(n - 1), 0)))
    return rows.withColumns({"rv_d": F.col(variance), "rv_w": mean(5), "rv_m": mean(22)})


def lag_features(rows: DataFrame, variance: str, lags: int = 22) -> DataFrame:
    """Log variance of today and the 21 days before, and the logs of the 5- and 22-day means."""
    logged = F.log(F.when(F.col(variance) > 0, F.col(variance)))
    out = rows.withColumns({f"lag_{k}": F.lag(logged, k).over(by_pos()) if k else logged for k in range(lags)})
    out = har_features(out, variance)
    return out.withColumns({"log_w": F.log("rv_w"), "log_m": F.log("rv_m")}).drop("rv_d", "rv_w", "rv_m")


NATIVE = {"naive": trailing_variance, "ewma": weighted_variance}


def forecasts(series: DataFrame, ret: str, window: int, models: tuple[str, ...] = ("naive", "ewma")) -> DataFrame:
    """A row for each (asset, pos, model) with forecast_var; all models share the one sort by position."""
    wide = series.withColumns({m: NATIVE[m](ret, window) for m in models})
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("forecast_var")) for m in models]))
    return wide.select(*series.columns, pairs.alias("__m")).select(*series.columns, "__m.model", "__m.forecast_var")
