"""Bars from ticks and minutes, their repair, targets and realised variance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import proxies as P

#: Relative violations up to this are clamped, larger ones mark the bar inconsistent.
TOLERANCE = 1e-5
DAY_MINUTES = 24 * 60


def ohlcv(ticks: DataFrame, by: list[Column], price: str, order: Column, volume: str | None = None) -> DataFrame:
    """open, high, low, close (first, max, min, last by ``order``) and volume of each group: one hash aggregation with map-side combine."""
    aggregates = [F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close")]
    if volume:
        aggregates.append(F.sum(volume).alias("volume"))
    return ticks.groupBy(*by).agg(*aggregates)


def sampled(ticks: DataFrame, minutes: int, price: str = "close") -> DataFrame:
    """Last price of each left-closed, left-labelled bucket; empty buckets have no row.  ``minutes`` must divide a day."""
    if minutes <= 0 or DAY_MINUTES % minutes:
        raise ValueError(f"{minutes} minutes do not divide a day")
    bucket = F.window("ts", f"{minutes} minutes")
    return ticks.groupBy("asset", bucket).agg(F.max_by(price, "ts").alias("close")).select("asset", F.col("window.start").alias("ts"), "close")


def daily_from_minutes(minutes: DataFrame) -> DataFrame:
    """Daily OHLCV by UTC day of bars (asset, ts, open, high, low, close, volume)."""
    return minutes.groupBy("asset", F.to_date("ts").alias("day")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))


def first_of_each_time(rows: DataFrame, order: str) -> DataFrame:
    """One row for each (asset, ts): the first by ``order``."""
    w = Window.partitionBy("asset", "ts").orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def realized_variance(bars: DataFrame, min_bars: int = 2) -> DataFrame:
    """Sum of squared log returns within each UTC day; NULL below ``min_bars`` prices.

    The lag is partitioned by day, so the return across midnight never enters.
    """
    day = Window.partitionBy("asset", "day").orderBy("ts")
    rows = bars.withColumn("day", F.to_date("ts")).withColumn("l", F.log(P.positive("close")))
    rows = rows.withColumn("r2", F.pow(F.col("l") - F.lag("l").over(day), F.lit(2.0)))
    out = rows.groupBy("asset", "day").agg(F.sum("r2").alias("s"), F.count("*").alias("n_bars"))
    return out.select("asset", "day", F.when(F.col("n_bars") >= min_bars, F.coalesce("s", F.lit(0.0))).alias("realized_variance"), "n_bars")


def repaired(bars: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds violation, inconsistent and clamped, and stretches bounds that miss open or close by at most ``tolerance``."""
    v = bars.withColumn("violation", P.violation())
    clamp = (F.col("violation") > 0) & (F.col("violation") <= tolerance)
    high, low = F.greatest("open", "close"), F.least("open", "close")
    return v.withColumns({
        "clamped": F.coalesce(clamp, F.lit(False)),
        "inconsistent": F.coalesce(F.col("violation") > tolerance, F.lit(False)),
        "raw_high": F.col("high"),
        "raw_low": F.col("low"),
        "high": F.when(clamp, F.greatest("high", high)).otherwise(F.col("high")),
        "low": F.when(clamp, F.least("low", low)).otherwise(F.col("low")),
    })


def quality(rows: DataFrame) -> DataFrame:
    """Five counters for each asset, on the values before repair."""
    one = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy("asset").agg(
        F.count("*").alias("n_bars"),
        one(F.col("inconsistent")).alias("n_inconsistent"),
        one(F.col("clamped")).alias("n_clamped"),
        one(F.col("raw_high") == F.col("raw_low")).alias("n_zero_range"),
        one((F.col("raw_high") <= 0) | (F.col("raw_low") <= 0)).alias("n_nonpositive"),
    )


def targets(rows: DataFrame) -> DataFrame:
    """Daily variance targets; range targets are NULL on inconsistent bars, rows are never dropped.

    Trim to a window only after this, so that its first day keeps a previous close.
    """
    ok = ~F.col("inconsistent")
    return rows.withColumns({
        "ret": P.log_return(),
        "squared_return": P.squared_return(),
        "parkinson": F.when(ok, P.parkinson()),
        "garman_klass": F.when(ok, P.garman_klass()),
        "overnight_plus_range": F.when(ok, P.overnight_variance() + P.rogers_satchell()),
    })


def trimmed(rows: DataFrame, start, end) -> DataFrame:
    return rows.where(F.col("ts").between(F.lit(start), F.lit(end)))


def validated(bars: DataFrame) -> DataFrame:
    """Rows that no bar table may hold, with the reason: missing time, repeated time, missing price."""
    repeated = bars.where("ts is not null").groupBy("asset", "ts").agg(F.count("*").alias("n")).where("n > 1").select("asset", "ts", F.lit("repeated time").alias("reason"))
    bad = F.coalesce(F.isnan("close"), F.lit(True))
    return repeated.unionByName(bars.where(F.col("ts").isNull()).select("asset", "ts", F.lit("missing time").alias("reason"))).unionByName(bars.where(bad).select("asset", "ts", F.lit("missing price").alias("reason")))
