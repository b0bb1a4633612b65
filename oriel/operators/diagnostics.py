"""Descriptive statistics of series and their targets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def finite(c: str):
    x = F.col(c)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def diagnose(targets: DataFrame, year: float = 252.0) -> DataFrame:
    """One row for each asset: span, gaps, return moments, target quantiles and invalid days, overnight share.

    ``targets``: bars with ret, parkinson, garman_klass, overnight_plus_range and
    inconsistent.  The overnight share is a ratio of sums over days with both
    parts; the realised share uses variances of overnight and intraday returns.
    """
    by = Window.partitionBy("asset").orderBy("ts")
    before = F.lag("close").over(by)
    rows = targets.withColumns({
        "gap": F.datediff("ts", F.lag("ts").over(by)),
        "on_r": F.log(F.when(F.col("open") > 0, F.col("open")) / F.when(before > 0, before)),
        "in_r": F.log(F.when(F.col("close") > 0, F.col("close")) / F.when(F.col("open") > 0, F.col("open"))),
    })
    rows = rows.withColumn("on_v", F.pow("on_r", F.lit(2.0))).withColumn("in_v", F.col("overnight_plus_range") - F.col("on_v"))
    both = F.col("on_v").isNotNull() & F.col("in_v").isNotNull()
    paired = F.col("on_r").isNotNull() & F.col("in_r").isNotNull()
    t = finite("overnight_plus_range")
    out = rows.groupBy("asset").agg(
        F.count("*").alias("n_days"),
        F.min(F.to_date("ts")).alias("first_day"),
        F.max(F.to_date("ts")).alias("last_day"),
        F.max("gap").cast("long").alias("max_gap"),
        F.count_if(F.col("gap") > 4).alias("n_long_gaps"),
        F.avg("ret").alias("ret_mean"),
        F.stddev_samp("ret").alias("ret_sd"),
        F.skewness("ret").alias("ret_skew"),
        (F.kurtosis("ret")).alias("ret_kurt"),
        F.min("ret").alias("ret_min"),
        F.max("ret").alias("ret_max"),
        F.count_if(F.col("ret") == 0).alias("n_zero_returns"),
        F.count_if(~F.coalesce(t > 0, F.lit(False))).alias("n_invalid_targets"),
        *[F.percentile(t, F.lit(q)).alias(f"target_q{round(100 * q):02d}") for q in QUANTILES],
        F.avg(t).alias("target_mean"),
        F.avg(finite("parkinson")).alias("parkinson_mean"),
        F.avg(finite("garman_klass")).alias("garman_klass_mean"),
        F.try_divide(F.sum(F.when(both, F.col("on_v"))), F.sum(F.when(both, F.col("on_v") + F.col("in_v")))).alias("overnight_share"),
        F.count_if(paired).alias("n_paired"),
        F.var_samp(F.when(paired, F.col("on_r"))).alias("on_var"),
        F.var_samp(F.when(paired, F.col("in_r"))).alias("in_var"),
        F.var_samp(F.when(paired, F.col("on_r") + F.col("in_r"))).alias("both_var"),
        F.count_if(F.col("inconsistent")).alias("n_inconsistent"),
    )
    enough = F.col("n_paired") > 2
    return out.withColumns({
        "annual_vol": F.col("ret_sd") * math.sqrt(year),
        "realized_overnight_share": F.when(enough, F.try_divide(F.col("on_var"), F.col("on_var") + F.col("in_var"))),
        "decomposition_ratio": F.when(enough, F.try_divide(F.col("on_var") + F.col("in_var"), F.col("both_var"))),
    }).drop("on_var", "in_var", "both_var")


def rounded(table: DataFrame, places: int = 4) -> DataFrame:
    return table.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes])
