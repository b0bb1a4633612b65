"""Volatility-targeting book: positions, turnover, costs, equity, drawdown, ratios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import periods_per_year


@dataclass(frozen=True)
class Book:
    annual_target_vol: float = 0.10
    leverage_cap: float = 2.0
    cost_bps: float = 10.0
    risk_free_annual: float = 0.0
    periods: float | None = None  # periods a year; by asset if unset
    scale: float = 1.0  # factor on log returns and forecast volatilities

    def __post_init__(self):
        if self.leverage_cap <= 0 or self.annual_target_vol <= 0 or self.cost_bps < 0 or self.scale <= 0:
            raise ValueError("cap, target and scale must be above 0 and costs not below")


def path(rows: DataFrame, book: Book = Book()) -> DataFrame:
    """Per period: position, turnover, gross and net return, equity, drawdown, for each (asset, model).

    A forecast that cannot be used means no position.  The first turnover is
    against an empty book.  Once wealth is gone it stays 0.
    """
    by = Window.partitionBy("asset", "model").orderBy("origin_index")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    year = F.lit(book.periods) if book.periods else periods_per_year(F.col("asset"))
    vol = F.sqrt(F.when(F.col("forecast_var") > 0, F.col("forecast_var"))) * book.scale
    out = rows.withColumn("periods_per_year", year).withColumn("position", F.when(vol.isNotNull(), F.least(book.annual_target_vol / F.sqrt("periods_per_year") / vol, F.lit(book.leverage_cap))).otherwise(0.0))
    simple = F.coalesce(F.expm1(F.col("realized_return") * book.scale), F.lit(0.0))
    out = out.withColumns({"gross": F.col("position") * simple, "turnover": F.abs(F.col("position") - F.coalesce(F.lag("position").over(by), F.lit(0.0)))})
    out = out.withColumn("net", F.col("gross") - F.col("turnover") * (book.cost_bps / 10_000))
    out = out.withColumn("ruined", F.max(F.col("net") <= -1).over(upto))
    growth = F.when(F.col("net") > -1, F.log1p("net")).otherwise(0.0)
    out = out.withColumn("equity", F.when(F.col("ruined"), 0.0).otherwise(F.exp(F.sum(growth).over(upto))))
    return out.withColumn("drawdown", 1 - F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(upto)))


def report(periods: DataFrame, book: Book = Book()) -> DataFrame:
    """Annual figures for each (asset, model)."""

    def sharpe(c: str, prefix: str):
        sd, top = F.col(f"{prefix}_sd"), F.col(f"{prefix}_top")
        ok = (F.col("n_periods") >= 2) & (sd > 0) & ~((top > 0) & (sd < 1e-12 * top))
        return F.when(ok, F.col(f"{prefix}_mean") / F.when(ok, sd) * F.sqrt("periods_per_year")).alias(c)

    daily = F.lit(book.risk_free_annual) / F.col("periods_per_year")
    rows = periods.withColumns({"net_x": F.col("net") - daily, "gross_x": F.col("gross") - daily})
    stats = [f(c).alias(f"{c[:-2]}_{k}") for c in ("net_x", "gross_x") for k, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    tops = [F.max(F.abs(c)).alias(f"{c[:-2]}_top") for c in ("net_x", "gross_x")]
    out = rows.groupBy("asset", "model").agg(
        F.count("*").alias("n_periods"), F.count_if(F.col("position") == 0).alias("n_flat"), F.first("periods_per_year").alias("periods_per_year"),
        F.max_by("equity", "origin_index").alias("final"), F.stddev_samp("net").alias("net_dev"), F.max("drawdown").alias("max_drawdown"),
        F.avg("position").alias("avg_leverage"), F.avg("turnover").alias("avg_daily_turnover"), F.max("ruined").alias("ruined"), *stats, *tops,
    )
    year = F.col("periods_per_year")
    return out.select(
        "asset", "model", "n_periods", "n_flat", "periods_per_year",
        F.when(F.col("final") <= 0, -1.0).otherwise(F.pow("final", year / F.col("n_periods")) - 1).alias("annual_return"),
        (F.col("net_dev") * F.sqrt(year)).alias("annual_vol"),
        sharpe("sharpe", "net"), sharpe("gross_sharpe", "gross"),
        F.greatest("max_drawdown", F.lit(0.0)).alias("max_drawdown"), "avg_leverage", "avg_daily_turnover",
        (F.col("avg_daily_turnover") * year).alias("annual_turnover"), (F.col("avg_daily_turnover") * (book.cost_bps / 10_000) * year).alias("annual_cost_drag"), "ruined",
    )
