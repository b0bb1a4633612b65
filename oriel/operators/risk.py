"""Backtests of value at risk and expected shortfall, for all cells and levels in one job."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.normal import cumulative

#: Fewer expected exceedances than this make a test a small sample.
MIN_EXPECTED = 10


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of chi-square: 2 (1 - Phi(sqrt x)) for 1 degree, exp(-x/2) for 2."""
    return 2 * cumulative(-F.sqrt(x)) if df == 1 else F.exp(-x / 2)


def long_levels(rows: DataFrame, levels: tuple[float, ...] = M.LEVELS, policy: str = "flagged") -> DataFrame:
    """A row for each scored row and level: hit, var, es; under 'flagged' the hit of a row with a missing reason is NULL."""
    if policy not in ("flagged", "score"):
        raise ValueError(f"unknown policy {policy}")
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("level"), F.col(f"hit_{t}").alias("hit"), F.col(f"var_{t}").alias("var"), F.col(f"es_{t}").alias("es")) for a in levels for t in (M.level_tag(a),)]))
    out = rows.select("asset", "model", "origin_index", "realized_return", "missing_reason", each.alias("x")).select("asset", "model", "origin_index", "realized_return", "missing_reason", "x.*")
    return out if policy == "score" else out.withColumn("hit", F.when(F.col("missing_reason") == "", F.col("hit")))


def hit_tests(hits: DataFrame) -> DataFrame:
    """Unconditional coverage, independence and conditional coverage for each (asset, model, level).

    Transitions count only between neighbouring rows that are both usable: the
    lag runs before missing hits are dropped.
    """
    by = ["asset", "model", "level"]
    w = Window.partitionBy(*by).orderBy("origin_index")
    rows = hits.withColumn("prev", F.lag("hit").over(w))
    pair = lambda a, b: F.count_if((F.col("prev") == a) & (F.col("hit") == b))
    loss = M.fz0(F.col("realized_return"), F.col("var"), F.col("es"), F.col("level"))
    out = rows.withColumn("fz0", F.when(F.col("hit").isNotNull(), loss)).groupBy(*by).agg(
        F.count("hit").alias("n"), F.coalesce(F.sum("hit"), F.lit(0.0)).cast("long").alias("n_hits"), F.count_if(F.col("hit").isNull()).alias("n_dropped"),
        pair(0, 0).alias("n00"), pair(0, 1).alias("n01"), pair(1, 0).alias("n10"), pair(1, 1).alias("n11"),
        F.avg("fz0").alias("fz0_mean"), F.count("fz0").alias("fz0_n"),
    )
    c = F.col
    level, n, x = c("level"), c("n").cast("double"), c("n_hits").cast("double")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"hit_rate": F.try_divide(x, n), "expected_hits": n * level, "small_sample": n * level < MIN_EXPECTED, "pi01": share(c("n01"), c("n00") + c("n01")), "pi11": share(c("n11"), c("n10") + c("n11")), "pi": share(c("n01") + c("n11"), c("n00") + c("n01") + c("n10") + c("n11"))})
    xl = M.x_log_y
    null = xl(n - x, 1 - level) + xl(x, level)
    free = xl(n - x, 1 - c("hit_rate")) + xl(x, c("hit_rate"))
    zero, one = (c("n00") + c("n10")).cast("double"), (c("n01") + c("n11")).cast("double")
    at_level = xl(zero, 1 - level) + xl(one, level)
    at_pi = xl(zero, 1 - c("pi")) + xl(one, c("pi"))
    markov = xl(c("n00").cast("double"), 1 - c("pi01")) + xl(c("n01").cast("double"), c("pi01")) + xl(c("n10").cast("double"), 1 - c("pi11")) + xl(c("n11").cast("double"), c("pi11"))
    ratio = lambda a, b: F.when(n > 0, F.greatest(-2 * (a - b), F.lit(0.0)))
    out = out.withColumns({"lr_pof": ratio(null, free), "lr_uc": ratio(at_level, at_pi), "lr_ind": ratio(at_pi, markov)})
    out = out.withColumn("lr_cc", c("lr_uc") + c("lr_ind"))
    return out.withColumns({"p_pof": chi2_sf(c("lr_pof"), 1), "p_uc": chi2_sf(c("lr_uc"), 1), "p_ind": chi2_sf(c("lr_ind"), 1), "p_cc": chi2_sf(c("lr_cc"), 2)})


def kupiec(n: int, hits: int, level: float) -> tuple[float, float]:
    """Likelihood ratio and p-value of unconditional coverage for plain counts."""
    if n < 1 or not 0 < level < 1:
        raise ValueError("need an observation and a level within (0, 1)")
    part = lambda k, p: 0.0 if k == 0 else k * math.log(p)
    lr = max(0.0, 2 * (part(n - hits, 1 - hits / n) + part(hits, hits / n) - part(n - hits, 1 - level) - part(hits, level)))
    return lr, math.erfc(math.sqrt(lr / 2))
