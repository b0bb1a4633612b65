"""Rolling evaluation of any models over all assets in one job.

Native models stay window expressions.  Block models run on grouped Arrow
batches: a group is one refit block of one (asset, model) and carries only the
rows its windows need.  A failed fit fails its block, a failed update or
prediction one origin; neither ever fails the job.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.dist import Distribution
from ..models.base import status_of
from ..models.native import forecasts
from ..operators import positions as Pos
from ..operators import scoring


@dataclass(frozen=True)
class Arm:
    """Protocol between refits: 'daily' conditions on newer data at fixed parameters, 'none' holds the forecast."""

    recondition: str = "daily"

    def __post_init__(self):
        if self.recondition not in ("daily", "none"):
            raise ValueError("recondition is 'daily' or 'none'")


def reason_of(stage: str, origin: int, e: BaseException) -> str:
    return f"{stage}@{origin}: {type(e).__name__}: {' '.join(str(e).split())}"


@dataclass(frozen=True)
class Native:
    """A model that is a window expression, as a grid or a backtest names it."""

    name: str

    def spec(self) -> dict:
        return {"native": self.name}


def run_backtest(series: DataFrame, models, s: Pos.Splitter, ret: str, proxy: str, variance: str | None = None, arm: Arm = Arm(), seed: int = 0, compact: bool = False, levels=M.LEVELS, only: DataFrame | None = None) -> DataFrame:
    """Scored rows of native and block models together, in the columns of ``block_schema``.

    ``only`` (asset, model) names the cells to compute, all if it is not given.
    """
    native = tuple(m.name for m in models if isinstance(m, Native))
    block = [m for m in models if not isinstance(m, Native)]
    columns, out = [f.split()[0] for f in block_schema(levels).split(", ")], None
    if native:
        rows = native_scores(series, s, ret, proxy, native, arm, seed, levels)
        if only is not None:
            rows = rows.join(F.broadcast(only), ["asset", "model"], "left_semi")  # a row a cell
        kinds = dict(f.split() for f in block_schema(levels).split(", "))
        out = rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns])
    if block:
        rows = block_scores(series, block, s, ret, proxy, variance, arm, seed, compact, levels, only)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("a backtest needs a model")
    return out


def native_scores(series: DataFrame, s: Pos.Splitter, ret: str, proxy: str, models=("naive", "ewma"), arm: Arm = Arm(), seed: int = 0, levels=M.LEVELS) -> DataFrame:
    """Scored rows of native models.  series: (asset, ts, pos, n, ret, proxy).

    What comes to pass is read ahead by the window that is there anyway: the
    series is scanned once and joined with nothing.
    """
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.lead(c, h).over(Pos.by_pos()).alias(a) for c, a in ((ret, "realized_return"), (proxy, "proxy_var"), ("ts", "target_ts"))]) for h in range(1, s.horizon + 1)])
    made = forecasts(series.select("asset", "ts", "pos", "n", ret, proxy).withColumn("ahead", ahead), ret, s.window, models)
    out = Pos.origins(made, s)
    if arm.recondition == "none":
        held = made.select("asset", "model", F.col("pos").alias("fit_origin"), F.col("forecast_var").alias("held_var"))
        out = out.join(held, ["asset", "model", "fit_origin"], "left").withColumn("forecast_var", F.col("held_var")).drop("held_var")
    out = out.withColumn("conditioned_through", F.col("pos") if arm.recondition == "daily" else F.col("fit_origin"))
    out = out.withColumn("a", F.explode("ahead")).select("asset", "model", F.col("pos").alias("origin_index"), "refit", "fit_origin", "conditioned_through", "forecast_var", "a.*")
    out = out.withColumns({"target_index": F.col("origin_index") + F.col("horizon"), "forecast_mean": F.lit(0.0), "seed": F.lit(seed).cast("long"), "fit_status": F.lit(""), "proxy_name": F.lit(proxy)})
    return scoring.normal_scores(out, levels)


def block_schema(levels=M.LEVELS) -> str:
    named = [f"{k}_{M.level_tag(a)} double" for a in levels for k in ("var", "es", "pinball", "hit")]
    return "asset string, model string, origin_index long, horizon long, target_index long, fit_origin long, conditioned_through long, refit boolean, seed long, forecast_mean double, forecast_var double, realized_return double, proxy_name string, proxy_var double, crps double, log_score double, qlike double, missing_reason string, fit_status string, " + ", ".join(named)


def score_row(d: Distribution, y: float, proxy: float, levels=M.LEVELS) -> dict:
    """All scores of one forecast; missing ones None, with the reasons."""
    out, why = {}, set()
    mean, var = d.moments()
    out["forecast_mean"], out["forecast_var"] = mean, var
    seen = math.isfinite(y)
    if not seen:
        why.add("target_nan")
    if math.isnan(proxy):
        why.add("proxy_nan")
    elif math.isinf(proxy):
        why.add("proxy_not_finite")
    elif proxy <= 0:
        why.add("proxy_nonpositive")
    if not var > 0:
        why.add("forecast_var_nonpositive")
    if seen:
        out["crps"] = d.crps(y)
        try:
            out["log_score"] = d.log_score(y)
        except NotImplementedError:
            why.add("log_score_undefined")
    if var > 0 and math.isfinite(proxy) and proxy > 0:
        out["qlike"] = proxy / var - math.log(proxy / var) - 1
    for a in levels:
        t, q = M.level_tag(a), d.quantile(a)
        out[f"var_{t}"] = q
        try:
            out[f"es_{t}"] = d.expected_shortfall(a)
        except (NotImplementedError, ValueError):
            why.add("es_undefined")
        if seen:
            out[f"pinball_{t}"], out[f"hit_{t}"] = d.pinball(y, a), float(y < q)
    out["missing_reason"] = "|".join(sorted(why))
    return out


def run_block(model, pdf: pd.DataFrame, s: Pos.Splitter, arm: Arm, proxy_name: str, seed: int, compact: bool = False, levels=M.LEVELS) -> pd.DataFrame:
    """One refit block: rows (pos, x, y, proxy, valid, is_origin, k) of one asset in order."""
    pdf = pdf.sort_values("pos")
    pos, x = pdf.pos.to_numpy(), pdf.x.to_numpy(float)
    at = {int(p): i for i, p in enumerate(pos)}
    y, proxy = pdf.y.to_numpy(float), pdf.proxy.to_numpy(float)
    usable = np.flatnonzero(pdf.valid.to_numpy(bool)) if compact else np.arange(len(pos))

    def window(i: int) -> np.ndarray:
        upto = usable[: np.searchsorted(usable, i, "right")]
        if len(upto) < s.window:
            raise ValueError(f"insufficient history: {len(upto)} usable of {s.window}")
        return x[upto[-s.window :]]

    rows, fitted, fit_at, failure = [], None, -1, ""
    for i in np.flatnonzero(pdf.is_origin.to_numpy(bool)):
        origin, refit = int(pos[i]), bool(pdf.k.iloc[i] % s.refit_every == 0)
        through, own = fit_at, failure
        if fitted is None and not failure:
            try:
                fitted, fit_at = model.fit(window(i)), origin
                through = origin
            except Exception as e:  # any model may fail in any way; the row says how
                failure = own = reason_of("fit_error", origin, e)
        elif fitted is not None:
            through = fit_at
            if arm.recondition == "daily" and hasattr(fitted, "update"):
                try:
                    now = fitted.update(window(i))
                    through = origin
                except Exception as e:
                    now, own = None, reason_of("update_error", origin, e)
            else:
                now = fitted
        state = fitted if fit_at == origin else (now if fitted is not None else None)
        for h in range(1, s.horizon + 1):
            row = {"asset": pdf.asset.iloc[0], "model": model.name, "origin_index": origin, "horizon": h, "target_index": origin + h, "fit_origin": fit_at, "conditioned_through": through if state is not None else -1, "refit": refit, "seed": seed, "proxy_name": proxy_name, "fit_status": status_of(state) if state is not None else "", "missing_reason": own}
            j = at.get(origin + h)
            row["realized_return"], row["proxy_var"] = (float(y[j]), float(proxy[j])) if j is not None else (math.nan, math.nan)
            if state is not None and not own:
                stage = "predict_error"
                try:
                    d = state.predict(h)
                    stage = "score_error"
                    row |= score_row(d, row["realized_return"], row["proxy_var"], levels)
                except Exception as e:
                    row["missing_reason"] = reason_of(stage, origin, e)
            rows.append(row)
    return pd.DataFrame(rows)


def _block_runner(by_name: dict, s: Pos.Splitter, arm: Arm, proxy: str, seed: int, compact: bool, names: list[str], kinds: dict, levels=M.LEVELS):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = run_block(by_name[pdf.model.iloc[0]], pdf, s, arm, proxy, seed, compact, levels)
        for n in names:
            if n not in got:
                got[n] = None if kinds[n] == "string" else np.nan
        got = got[names]
        # NaN becomes null, so that averages skip it
        return got.astype({n: "object" for n in names if kinds[n] == "double"}).where(got.notna(), None)

    return one


def block_scores(series: DataFrame, models, s: Pos.Splitter, ret: str, proxy: str, variance: str | None = None, arm: Arm = Arm(), seed: int = 0, compact: bool = False, levels=M.LEVELS, only: DataFrame | None = None) -> DataFrame:
    """Scored rows of block models: series (asset, ts, pos, n, ret, proxy[, variance]).

    A block's group holds its origins, the window before them and the targets
    after.  With ``compact`` windows are the last valid observations, so a
    group reaches back to the start of the series.
    """
    schema = block_schema(levels)
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {f.split()[0]: f.split()[1] for f in schema.split(", ")}
    span = s.refit_every * s.step
    out = None
    for on_variance in (False, True):
        chosen = [m for m in models if m.on_variance == on_variance]
        if not chosen:
            continue
        x = F.col((variance or proxy) if on_variance else ret)
        first, last = s.window - 1, F.col("n") - 1 - s.horizon
        # the blocks whose windows, origins or targets a row lies in
        low = F.greatest(F.floor((F.col("pos") - s.horizon - first) / span), F.lit(0))
        low = F.when(F.col("pos") - s.horizon - first < 0, F.lit(0)).otherwise(low)
        high = F.floor((last - first) / span) if compact else F.least(F.floor((F.col("pos") + s.window - 1 - first) / span), F.floor((last - first) / span))
        rows = series.where(F.col("n") > s.window + s.horizon - 1).select(
            "asset", "pos", x.alias("x"), F.col(ret).alias("y"), F.col(proxy).alias("proxy"),
            F.coalesce((x > 0) & (x < float("inf")), F.lit(False)).alias("valid") if on_variance else F.col(ret).isNotNull().alias("valid"),
            F.floor((F.col("pos") - first) / s.step).cast("long").alias("k"),
            ((F.col("pos") >= first) & (F.col("pos") <= last) & ((F.col("pos") - first) % s.step == 0)).alias("candidate"),
            F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("block"),
        )
        rows = rows.withColumn("is_origin", F.col("candidate") & (F.floor(F.col("k") / s.refit_every) == F.col("block"))).drop("candidate")
        rows = rows.select("*", F.explode(F.array(*[F.lit(m.name) for m in chosen])).alias("model"))
        if only is not None:
            rows = rows.join(F.broadcast(only), ["asset", "model"], "left_semi")  # a row a cell
        by_name = {m.name: m for m in chosen}

        part = rows.groupBy("asset", "model", "block").applyInPandas(_block_runner(by_name, s, arm, proxy, seed, compact, names, kinds, levels), schema)
        out = part if out is None else out.unionByName(part)
    return out
