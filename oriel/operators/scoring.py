"""Scored rows: forecasts at origins joined with what came to pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import normal as N

KEYS = ["config_hash", "asset", "origin_index", "horizon"]


def reasons(forecast_var: str = "forecast_var", ret: str = "realized_return", proxy: str = "proxy_var"):
    """The sorted, '|'-joined reasons why scores of a row are missing; '' if none is."""
    f, r, p = F.col(forecast_var), F.col(ret), F.col(proxy)
    unset = lambda c: c.isNull() | F.isnan(c)
    each = [
        F.when(f.isNull() | F.isnan(f) | (f <= 0), "forecast_var_nonpositive"),
        F.when(unset(p), "proxy_nan"),
        F.when(~unset(p) & (F.abs(p) == float("inf")), "proxy_not_finite"),
        F.when(~unset(p) & (F.abs(p) != float("inf")) & (p <= 0), "proxy_nonpositive"),
        F.when(unset(r), "target_nan"),
    ]
    return F.array_join(F.array_sort(F.array_compact(F.array(*each))), "|")


def realised(forecasts: DataFrame, series: DataFrame, ret: str, proxy: str) -> DataFrame:
    """Joins return and proxy at (asset, target_index): an equi-join on the shifted position."""
    right = series.select("asset", F.col("pos").alias("target_index"), F.col(ret).alias("realized_return"), F.col(proxy).alias("proxy_var"), F.col("ts").alias("target_ts"))
    return forecasts.join(right, ["asset", "target_index"], "left")


def normal_scores(rows: DataFrame, levels: tuple[float, ...] = M.LEVELS) -> DataFrame:
    """Scores of normal forecasts (forecast_mean, forecast_var): crps, log_score, qlike, and var, es, pinball and hit for each level.

    Risk measures stand even where the target is missing; scores do not.
    """
    var, y, p = F.col("forecast_var"), F.col("realized_return"), F.col("proxy_var")
    rows = rows.withColumn("__s", F.sqrt(F.when(var > 0, var))).withColumn("__z", (y - F.col("forecast_mean")) / F.col("__s"))
    s, z, mu = F.col("__s"), F.col("__z"), F.col("forecast_mean")
    rows = rows.withColumns({"crps": N.crps(z, s), "log_score": N.log_score(z, s), "qlike": M.qlike(var, p), "missing_reason": reasons()})
    rows = rows.withColumns({f"{k}_{M.level_tag(a)}": f(mu, s, a) for a in levels for k, f in (("var", N.value_at_risk), ("es", N.expected_shortfall))})
    rows = rows.withColumns({f"{k}_{M.level_tag(a)}": f(a, F.col(f"var_{M.level_tag(a)}")) for a in levels for k, f in (("pinball", lambda a, q: M.pinball(y, q, a)), ("hit", lambda a, q: M.hit(y, q)))})
    return rows.drop("__s", "__z")


def canonical(rows: DataFrame) -> DataFrame:
    """Key columns, then the rest by name, rows by key."""
    rest = sorted(c for c in rows.columns if c not in KEYS)
    return rows.select(*[c for c in KEYS if c in rows.columns], *rest).orderBy(*[c for c in KEYS if c in rows.columns])


def summary(rows: DataFrame, levels: tuple[float, ...] = M.LEVELS, by: str = "model") -> DataFrame:
    """Mean scores of each model; missing scores are skipped."""
    return rows.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count("crps").alias("n_scored"),
        F.avg("crps").alias("crps"),
        F.avg("log_score").alias("log_score"),
        F.avg("qlike").alias("qlike"),
        F.avg(F.sqrt("forecast_var")).alias("mean_vol"),
        *[F.avg(f"hit_{M.level_tag(a)}").alias(f"hit_{M.level_tag(a)}") for a in levels],
    )
