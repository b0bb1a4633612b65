"""Forecast comparison: loss matrices, Diebold-Mariano, block bootstrap, model confidence sets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import t_cdf

#: Resamples drawn together; part of a seed's meaning.
CHUNK = 256
MCS_SCHEMA = "asset string, horizon long, model string, mean_loss double, p_value double, included boolean, eliminated long, step_p double, n long, n_dropped long, block_length long"


def losses(rows: DataFrame, score: str, policy: str = "flagged") -> DataFrame:
    """Long loss table (asset, horizon, origin_index, model, loss); under 'flagged' rows with a missing reason lose their loss."""
    if policy not in ("flagged", "score"):
        raise ValueError(f"unknown policy {policy}")
    loss = F.when(F.col("missing_reason") == "", F.col(score)) if policy == "flagged" else F.col(score)
    finite = F.when(~F.isnan(loss) & (F.abs(loss) < float("inf")), loss)
    return rows.select("asset", "horizon", "origin_index", "model", finite.alias("loss"))


def loss_matrix(long: DataFrame, models: list[str]) -> DataFrame:
    """One column for each model; models are named, so no extra pass finds them."""
    return long.groupBy("asset", "horizon", "origin_index").pivot("model", models).agg(F.first("loss"))


def ambiguous(long: DataFrame) -> DataFrame:
    """Keys with more than one loss: a loss matrix must have none."""
    return long.groupBy("asset", "horizon", "origin_index", "model").agg(F.count("*").alias("n")).where("n > 1")


def diebold_mariano(long: DataFrame, lag: int | None = None, kernel: str = "rectangular", hln: bool = True, alternative: str = "two-sided") -> DataFrame:
    """Every ordered pair of models for each (asset, horizon): n, n_dropped, mean_diff, variance, variance_nonpositive, statistic, p_value.

    ``alternative`` is 'two-sided', 'less' (model_a has the smaller loss) or 'greater'.
    n_dropped counts origins at which either model has no loss.

    Pairs are complete pair by pair, and lags run over the compressed sequence.
    Grouped sums over arrays of differences; only the t distribution needs
    Python.  The reversed pair follows by antisymmetry.
    """
    if kernel not in ("rectangular", "bartlett"):
        raise ValueError(f"unknown kernel {kernel}")
    if alternative not in ("two-sided", "less", "greater"):
        raise ValueError(f"unknown alternative {alternative}")
    by = ["asset", "horizon", "model_a", "model_b"]
    # the losses of an origin are as many as there are models: pairs come from one array, without a self-join
    # (collect_list passes over missing ones; a filter would carry the score's whole expression down the plan)
    sets = long.groupBy("asset", "horizon", "origin_index").agg(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("model", "loss")))).alias("l"))
    pairs = F.flatten(F.transform("l", lambda x: F.transform(F.filter("l", lambda y: y["model"] > x["model"]), lambda y: F.struct(x["model"].alias("model_a"), y["model"].alias("model_b"), (x["loss"] - y["loss"]).alias("d")))))
    d = sets.select("asset", "horizon", "origin_index", F.explode(pairs).alias("p")).select("asset", "horizon", "p.model_a", "p.model_b", "origin_index", "p.d")
    d = d.withColumns({"mean": F.avg("d").over(Window.partitionBy(*by)), "lags": F.lit(lag) if lag is not None else F.col("horizon") - 1})
    d = d.withColumns({"e": F.col("d") - F.col("mean"), "t": F.row_number().over(Window.partitionBy(*by).orderBy("origin_index"))})
    arrays = d.groupBy(*by).agg(F.count("*").alias("n"), F.first("mean").alias("mean_diff"), F.first("lags").alias("lags"), F.transform(F.sort_array(F.collect_list(F.struct("t", "e"))), lambda x: x["e"]).alias("e"))
    gamma = lambda k: F.aggregate(F.zip_with(F.slice("e", k + 1, F.greatest(F.size("e") - k, F.lit(0))), F.slice("e", 1, F.greatest(F.size("e") - k, F.lit(0))), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / F.col("n")
    h = F.col("lags") + 1
    weight = (lambda k: F.lit(1.0)) if kernel == "rectangular" else (lambda k: 1 - k / h)
    long_run = F.aggregate(F.when(F.col("lags") >= 1, F.sequence(F.lit(1), F.col("lags"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, k: s + 2 * weight(k) * gamma(k))
    origins = sets.groupBy("asset", "horizon").agg(F.count("*").alias("origins"))  # a row for each asset and horizon
    arrays = arrays.join(origins, ["asset", "horizon"]).withColumn("n_dropped", F.col("origins") - F.col("n")).drop("origins")
    out = arrays.where(F.col("n") > F.greatest(h, F.lit(1))).withColumn("variance", (gamma(F.lit(0)) + long_run) / F.col("n"))
    n = F.col("n").cast("double")
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n) if hln else F.lit(1.0)
    diff, v = F.col("mean_diff"), F.col("variance")
    infinite = F.when(diff > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    out = out.withColumn("statistic", F.when(v > 0, factor * diff / F.sqrt(F.when(v > 0, v))).when(diff == 0, 0.0).otherwise(infinite)).drop("e", "lags")

    @F.pandas_udf("double")
    def p_value(stat: pd.Series, n: pd.Series) -> pd.Series:
        below = [t_cdf(s, k - 1) if hln else 0.5 * math.erfc(-s / math.sqrt(2)) for s, k in zip(stat, n, strict=True)]
        return pd.Series(below, dtype=float)  # probability of a smaller statistic

    out = out.withColumn("below", p_value("statistic", "n"))
    flip = lambda sign: F.col("below") if sign > 0 else 1 - F.col("below")
    tail = {"two-sided": lambda p: 2 * F.least(p, 1 - p), "less": lambda p: p, "greater": lambda p: 1 - p}[alternative]
    side = lambda a, b, sign: F.struct(F.col(a).alias("model_a"), F.col(b).alias("model_b"), (sign * F.col("mean_diff")).alias("mean_diff"), (sign * F.col("statistic")).alias("statistic"), tail(flip(sign)).alias("p_value"))
    both = out.select("asset", "horizon", "n", "n_dropped", "variance", F.explode(F.array(side("model_a", "model_b", 1.0), side("model_b", "model_a", -1.0))).alias("s"))
    return both.select("asset", "horizon", "s.model_a", "s.model_b", "n", "n_dropped", "s.mean_diff", "variance", (F.col("variance") <= 0).alias("variance_nonpositive"), "s.statistic", "s.p_value")


def block_sums(long: DataFrame, length: int) -> DataFrame:
    """Sum of ``length`` losses from each place on, over complete origins in order; the stuff of block resampling."""
    by = Window.partitionBy("asset", "model").orderBy("origin_index")
    rows = long.withColumn("t", F.row_number().over(by).cast("long") - 1).withColumn("n", F.count("*").over(Window.partitionBy("asset", "model")))
    return rows.withColumn("block_sum", F.sum("loss").over(by.rowsBetween(0, length - 1))).where(F.col("t") + length <= F.col("n")).select("asset", "model", "t", "block_sum")


def block_starts(n: int, length: int, n_boot: int, seed: int) -> np.ndarray:
    """Starts of the moving blocks of each resample, in chunks of ``CHUNK`` resamples."""
    if not 1 <= length <= n or n_boot < 1:
        raise ValueError("a block has 1 to n places, and there is a resample at least")
    rng, each = np.random.default_rng(seed), -(-n // length)
    return np.concatenate([rng.integers(0, n - length + 1, size=(min(CHUNK, n_boot - lo), each)) for lo in range(0, n_boot, CHUNK)])


def block_indices(n: int, length: int, n_boot: int, seed: int) -> np.ndarray:
    starts = block_starts(n, length, n_boot, seed)
    return (starts[:, :, None] + np.arange(length)).reshape(n_boot, -1)[:, :n]


def bootstrap_means(x: np.ndarray, length: int, n_boot: int, seed: int) -> np.ndarray:
    """Column means of the resamples by prefix sums: no array of n_boot x n."""
    n, m = x.shape
    sums = np.vstack((np.zeros((1, m)), np.cumsum(x, axis=0)))
    starts = block_starts(n, length, n_boot, seed)
    rest = n - (starts.shape[1] - 1) * length
    whole = (sums[starts[:, :-1] + length] - sums[starts[:, :-1]]).sum(axis=1)
    return (whole + sums[starts[:, -1] + rest] - sums[starts[:, -1]]) / n


def automatic_block_length(x: np.ndarray) -> float:
    """Politis-White block length with the correction of Patton, Politis and White, for moving blocks; 1 for a constant series."""
    n = len(x)
    e = x - x.mean()
    quiet = max(5, int(math.log10(n)))
    most = math.ceil(math.sqrt(n)) + quiet
    band = 2 * math.sqrt(math.log10(n) / n)
    lags = range(min(most, n - 2) + 1)
    cross = np.array([e[k:] @ e[: n - k] for k in lags])
    norm = np.array([math.sqrt((e[k + 1 :] @ e[k + 1 :]) * (e[: -(k + 1)] @ e[: -(k + 1)])) for k in lags])
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.where(norm > 0, np.abs(cross) / norm, np.nan)
    inside = corr < band
    start = next((k for k in range(len(corr) - quiet) if inside[k : k + quiet].all()), None)
    m = min(2 * max(start, 1), most) if start is not None else most
    k = np.arange(1, min(m, len(cross) - 1) + 1)
    window = np.minimum(1.0, 2 * (1 - k / m))
    acv = cross / n
    g, spectrum = 2 * float((window * k * acv[k]).sum()), float(acv[0] + 2 * (window * acv[k]).sum())
    if not spectrum**2 > 0 or not math.isfinite(g):
        return 1.0
    b = (2 * g * g / (4 / 3 * spectrum**2)) ** (1 / 3) * n ** (1 / 3)
    return min(b, float(math.ceil(min(3 * math.sqrt(n), n / 3)))) if math.isfinite(b) else 1.0


def default_block_length(x: np.ndarray, horizon: int = 1) -> int:
    """The longest automatic length over all loss differentials, at least the horizon and at most n."""
    n, m = x.shape
    if n < 3 or m < 2:
        return max(1, horizon)
    longest = max(automatic_block_length(x[:, i] - x[:, j]) for i in range(m) for j in range(i + 1, m))
    return int(min(max(horizon, 1, math.ceil(longest)), n))


def confidence_set(x: np.ndarray, seed: int, alpha: float = 0.1, n_boot: int = 10_000, length: int | None = None, statistic: str = "range", horizon: int = 1) -> dict:
    """Model confidence set of the columns of ``x`` (complete rows): p-values, order of elimination, steps."""
    if statistic not in ("range", "max") or not 0 < alpha < 1:
        raise ValueError("statistic is 'range' or 'max', alpha within (0, 1)")
    n, m = x.shape
    if n < 2 or m < 2:
        raise ValueError("a confidence set needs two models and two complete origins")
    length = length or default_block_length(x, horizon)
    mean = x.mean(axis=0)
    boot = bootstrap_means(x, length, n_boot, seed) - mean
    gram = boot.T @ boot / n_boot
    sd = np.sqrt(np.maximum(np.diag(gram)[:, None] + np.diag(gram)[None, :] - 2 * gram, 0))
    over = lambda a, b: np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=np.broadcast_to(b > 0, np.broadcast(a, b).shape))
    alive, p, order, steps, top = list(range(m)), {}, [], [], 0.0
    while len(alive) > 1:
        i = np.array(alive)
        if statistic == "range":
            t = over(mean[i][:, None] - mean[i][None, :], sd[np.ix_(i, i)])
            seen, out = np.abs(t).max(), int(i[t.max(axis=1).argmax()])
            drawn = np.zeros(n_boot)
            for u in range(len(i)):
                for v in range(u):
                    if sd[i[u], i[v]] > 0:
                        np.maximum(drawn, np.abs(boot[:, i[u]] - boot[:, i[v]]) / sd[i[u], i[v]], out=drawn)
        else:
            own = boot[:, i] - boot[:, i].mean(axis=1, keepdims=True)
            spread = np.sqrt((own**2).mean(axis=0))
            t = over(mean[i] - mean[i].mean(), spread)
            seen, out = t.max(), int(i[t.argmax()])
            drawn = over(own, spread[None, :]).max(axis=1)
        steps.append(float((drawn >= seen).mean()))
        top = max(top, steps[-1])
        p[out] = top
        order.append(out)
        alive.remove(out)
    p[alive[0]] = 1.0
    return {"p": [p[k] for k in range(m)], "included": [p[k] >= alpha for k in range(m)], "order": [*order, alive[0]], "steps": steps, "mean": mean, "length": length}


def _wide(pdf: pd.DataFrame) -> pd.DataFrame:
    """Origins x models; a second loss of one origin and model is an error."""
    return pdf.pivot(index="origin_index", columns="model", values="loss").sort_index()


def model_confidence_sets(long: DataFrame, seed: int, alpha: float = 0.1, n_boot: int = 10_000, length: int | None = None, statistic: str = "range") -> DataFrame:
    """A confidence set for each (asset, horizon): one Arrow group of origins x models; origins missing any model are dropped for all."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide, horizon = _wide(pdf), int(pdf.horizon.iloc[0])
        full = wide.dropna()
        r = confidence_set(full.to_numpy(float), seed, alpha, n_boot, length, statistic, horizon)
        rank = {k: i for i, k in enumerate(r["order"])}
        return pd.DataFrame({"asset": pdf.asset.iloc[0], "horizon": horizon, "model": list(full.columns), "mean_loss": r["mean"], "p_value": r["p"], "included": r["included"], "eliminated": [rank[k] for k in range(len(rank))], "step_p": [r["steps"][rank[k]] if rank[k] < len(r["steps"]) else 1.0 for k in range(len(rank))], "n": len(full), "n_dropped": len(wide) - len(full), "block_length": r["length"]})

    return long.groupBy("asset", "horizon").applyInPandas(one, MCS_SCHEMA)


def block_lengths(long: DataFrame) -> DataFrame:
    """Automatic block length of each pair of models, asset and horizon."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = _wide(pdf).dropna()
        c = list(wide.columns)
        out = [(pdf.asset.iloc[0], int(pdf.horizon.iloc[0]), c[i], c[j], automatic_block_length((wide[c[i]] - wide[c[j]]).to_numpy(float))) for i in range(len(c)) for j in range(i + 1, len(c))]
        return pd.DataFrame(out, columns=["asset", "horizon", "model_a", "model_b", "block_length"])

    return long.groupBy("asset", "horizon").applyInPandas(one, "asset string, horizon long, model_a string, model_b string, block_length double")


def comparison(long: DataFrame, seed: int, n_boot: int = 10_000) -> DataFrame:
    """Confidence set joined with how many others each model beats in pairwise tests at 5 per cent, by mean loss."""
    beats = diebold_mariano(long).groupBy("asset", F.col("horizon").cast("long").alias("horizon"), F.col("model_a").alias("model")).agg(F.count_if((F.col("statistic") < 0) & (F.col("p_value") < 0.05)).alias("n_beaten"))
    return model_confidence_sets(long, seed, n_boot=n_boot).join(beats, ["asset", "horizon", "model"], "left").orderBy("asset", "horizon", "mean_loss", "model")
