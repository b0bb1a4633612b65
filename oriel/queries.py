"""Registered queries: every operator over whole tables, with the same in DuckDB's SQL.

Daily bars come from ``lineitem`` (asset = return flag, price = extended price a
unit), minutes from ``events`` (asset = event type).  ``raw_bars`` spoils some
days, so that repair has work.  Floating results are rounded, since logarithms
differ in the last digit between engines.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics as M
from .functions import normal as N
from .functions import proxies as P
from .functions.dist import Distribution
from .models import block, native
from .operators import bars, diagnostics, econ, inference, positions, regimes, risk, scoring
from .plans import backtest, grid, identity, panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SPLIT = positions.Splitter(window=100, horizon=2, step=1, refit_every=21)
BLOCK_SPLIT = positions.Splitter(window=250, horizon=1, step=1, refit_every=21)
#: That of the SQL of block_naive_equals_native.
SQL_SPLIT = positions.Splitter(window=250, horizon=1, step=5, refit_every=21)
MODELS = ["ewma", "naive"]
REGIMES = regimes.checked((regimes.Regime("alpha", date(1993, 3, 1), date(1993, 9, 30)), regimes.Regime("beta", date(1995, 1, 15), date(1995, 6, 15)), regimes.Regime("gamma", date(1997, 11, 1), date(1998, 2, 28))))
COMPACT = 50
BOOK = econ.Book(scale=0.01)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 5) -> DataFrame:
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


# inputs ---------------------------------------------------------------------


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").where("l_quantity > 0 and l_extendedprice > 0")
    li = li.withColumns({"price": F.col("l_extendedprice") / F.col("l_quantity"), "day": F.to_date("l_shipdate")})
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    return bars.ohlcv(li, [F.col("l_returnflag").alias("asset"), F.col("day").alias("ts")], "price", order, "l_quantity")


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = F.dayofmonth("ts"), daily(spark, sf_dir)
    return b.withColumns({"high": F.when(d == 7, F.col("high") * (1 - 4e-6)).when(d == 13, F.col("high") * 0.9).when(d == 17, -F.col("high")).otherwise(F.col("high")), "low": F.when(d == 21, F.col("low") * (1 + 4e-6)).otherwise(F.col("low"))})


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.targets(bars.repaired(raw_bars(spark, sf_dir)))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, ts, pos, n, ret, proxy, rv): the rows that have a return."""
    t = targets(spark, sf_dir).where("ret is not null").select("asset", "ts", "ret", F.col("overnight_plus_range").alias("proxy"), F.greatest("squared_return", F.lit(1e-6)).alias("rv"))
    return positions.positioned(t)


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("value > 0")
    return e.select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("close"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.native_scores(series(spark, sf_dir), SPLIT, "ret", "proxy")


def block_rows(spark: SparkSession, sf_dir: str, *models, on: str = "proxy", split: positions.Splitter = BLOCK_SPLIT) -> DataFrame:
    return backtest.block_scores(series(spark, sf_dir), models, split, "ret", on, variance="rv")


# bars and targets -----------------------------------------------------------


@query
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir)


@query
def bars_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.sampled(minutes(spark, sf_dir), 5)
    return b.select("asset", F.col("ts").cast("timestamp_ntz").alias("ts"), "close")


@query
def bars_daily_from_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = minutes(spark, sf_dir).select("asset", "ts", F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", F.lit(1.0).alias("volume"))
    return bars.daily_from_minutes(m)


@query
def minute_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("value > 0").select(F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_id", F.col("value").alias("close"))
    return bars.first_of_each_time(e, "event_id")


@query
def realized_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.realized_variance(minutes(spark, sf_dir)))


@query
def realized_variance_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.realized_variance(bars.sampled(minutes(spark, sf_dir), 5), 12))


@query
def rv_left_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = minutes(spark, sf_dir).select("asset", F.to_date("ts").alias("day")).distinct()
    rv = bars.realized_variance(bars.sampled(minutes(spark, sf_dir), 60), 3)
    return rounded(days.join(rv.where("n_bars >= 20").select("asset", "day", "realized_variance"), ["asset", "day"], "left"))


def _proxy(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(daily(spark, sf_dir).select("asset", "ts", P.PROXIES[name]().alias("value")))

    run.__name__ = name
    return run


for _name in P.PROXIES:
    query(_proxy(_name))


@query
def ohlc_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_bars(spark, sf_dir).select("asset", "ts", P.consistent().alias("consistent"))


@query
def ohlc_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bars.repaired(raw_bars(spark, sf_dir))
    return r.select("asset", "ts", "high", "low", "clamped", "inconsistent")


@query
def bar_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.quality(bars.repaired(raw_bars(spark, sf_dir)))


@query
def bar_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.validated(daily(spark, sf_dir).select(F.lit("all").alias("asset"), "ts", "close"))


@query
def targets_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(targets(spark, sf_dir).select("asset", "ts", "squared_return", "parkinson", "garman_klass", "overnight_plus_range"))


@query
def targets_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bars.trimmed(targets(spark, sf_dir), date(1994, 1, 1), date(1995, 12, 31))
    return rounded(t.select("asset", "ts", "ret", "overnight_plus_range"))


@query
def invalid_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(spark, sf_dir).select("asset", "ts", P.usable("overnight_plus_range").alias("valid"))


@query
def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = targets(spark, sf_dir)
    return positions.misaligned(t, t.where("overnight_plus_range is not null"))


@query
def calendar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.calendar_gaps(daily(spark, sf_dir))


@query
def crisis_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = daily(spark, sf_dir).select("asset", "ts", regimes.tag_of(F.col("ts"), REGIMES).alias("regime"))
    return t.withColumn("regime_ord", regimes.order_of(F.col("regime"), REGIMES).cast("long"))


@query
def crisis_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.indicators(daily(spark, sf_dir).select("asset", "ts"), "ts", REGIMES)


@query
def dated_crises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dated crises over bars moved on by 14 years, into the times they lie in."""
    t = daily(spark, sf_dir).select("asset", F.add_months("ts", 168).alias("ts"))
    return t.select("asset", "ts", regimes.tag_of(F.col("ts")).alias("regime"), regimes.order_of(regimes.tag_of(F.col("ts"))).cast("long").alias("regime_ord"))


@query
def supervised_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = positions.supervised(series(spark, sf_dir), "ret", 10, 3)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rounded(w.select("asset", "pos", total("inputs").alias("inputs"), total("targets").alias("targets"), F.element_at("targets", -1).alias("last")))


@query
def panel_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and quality counts of a panel in one call."""
    t, q = panel.build(raw_bars(spark, sf_dir), start=date(1993, 1, 1), end=date(1996, 12, 31))
    n = t.groupBy("asset").agg(F.count("*").alias("n_days"), F.count("overnight_plus_range").alias("n_targets"))
    return n.join(q, "asset")


@query
def crisis_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    t = positions.exploded(positions.origins(s.select("asset", "pos", "n"), SPLIT), SPLIT.horizon).select("asset", F.col("target_index").alias("pos"))
    days = s.select("asset", "pos", F.col("ts").alias("day"))
    return regimes.coverage(t.join(days, ["asset", "pos"]).select("asset", "day"), days.select("asset", "day"), REGIMES)


@query
def series_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.diagnose(targets(spark, sf_dir)), 4)


# positions ------------------------------------------------------------------


@query
def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.origins(series(spark, sf_dir), positions.Splitter(50, 2, 3, 4)).select("asset", "pos", "k", "refit", "block_id", "fit_origin")


@query
def n_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.n_splits(series(spark, sf_dir), positions.Splitter(50, 2, 3, 4))


@query
def refit_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = positions.origins(series(spark, sf_dir), SPLIT)
    return o.groupBy("asset", "block_id").agg(F.count("*").alias("n_origins"), F.min("pos").alias("first_origin"), F.max("pos").alias("last_origin"))


@query
def train_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = positions.train_windows(series(spark, sf_dir), "ret", 20).where("train is not null")
    return rounded(t.select("asset", "pos", F.size("train").alias("n_train"), F.aggregate("train", F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at("train", 1).alias("oldest")))


@query
def target_explosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    t = positions.exploded(positions.origins(s.select("asset", "pos", "n"), SPLIT), SPLIT.horizon)
    return rounded(scoring.realised(t.select("asset", F.col("pos").alias("origin_index"), "horizon", "target_index"), s, "ret", "proxy").drop("target_ts"))


def _compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).withColumn("valid", P.usable("proxy"))


@query
def compaction_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = positions.compaction(_compact(spark, sf_dir), "valid", COMPACT)
    return w.fillna(-1, ["first_pos", "last_pos", "n_dropped"])


@query
def dropped_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _compact(spark, sf_dir)
    return positions.dropped_positions(positions.compaction(rows, "valid", COMPACT), rows, "valid")


# forecasts and scores -------------------------------------------------------


@query
def naive_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series(spark, sf_dir).select("asset", "pos", native.trailing_variance("ret", 100).alias("forecast_var")).where("forecast_var is not null"))


@query
def ewma_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series(spark, sf_dir).select("asset", "pos", native.weighted_variance("ret", 100).alias("forecast_var")).where("forecast_var is not null"))


@query
def har_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(native.har_features(series(spark, sf_dir), "rv").select("asset", "pos", "rv_d", "rv_w", "rv_m"))


@query
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(native.lag_features(series(spark, sf_dir), "rv").drop("ts", "n", "ret", "proxy", "rv"))


@query
def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).drop("target_ts", "proxy_name", "fit_status", "seed"))


def _of_scored(name: str, *columns: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(scored(spark, sf_dir).select("asset", "model", "origin_index", "horizon", *columns))

    run.__name__ = name
    query(run)


SCORED_VIEWS = {
    "normal_crps": ("crps",),
    "normal_log_score": ("log_score",),
    "normal_quantile_var_es": tuple(f"{k}_{M.level_tag(a)}" for a in M.LEVELS for k in ("var", "es")),
    "pinball_hits": tuple(f"{k}_{M.level_tag(a)}" for a in M.LEVELS for k in ("pinball", "hit")),
    "qlike": ("qlike",),
    "missing_reason": ("missing_reason",),
}
for _name, _columns in SCORED_VIEWS.items():
    _of_scored(_name, *_columns)


@query
def held_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = backtest.native_scores(series(spark, sf_dir), SPLIT, "ret", "proxy", arm=backtest.Arm("none"))
    return rounded(rows.select("asset", "model", "origin_index", "horizon", "fit_origin", "conditioned_through", "forecast_var"))


@query
def mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).groupBy("asset", "model").agg(F.avg(M.squared_error(F.col("forecast_var"), F.col("proxy_var"))).alias("mse"))
    return rounded(rows, 3)


@query
def fz0(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = M.fz0(F.col("realized_return"), F.col("var_0p05"), F.col("es_0p05"), 0.05)
    return rounded(scored(spark, sf_dir).select("asset", "model", "origin_index", "horizon", loss.alias("fz0")))


@query
def level_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a, M.level_tag(a), N.quantile_of(a)) for a in M.LEVELS], "level double, tag string, z double").select("level", "tag", F.round("z", 9).alias("z"))


@query
def empirical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRPS of the last 50 returns taken as samples, by the sorted identity, in array functions."""
    rows = positions.train_windows(series(spark, sf_dir), "ret", 50).where("train is not null")
    v, n = F.sort_array("train"), F.size("train")
    rows = rows.withColumn("next", F.lead("ret").over(positions.by_pos())).withColumn("v", v)
    near = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("next"))) / n
    spread = F.aggregate(F.transform("v", lambda x, i: (2 * (i + 1) - n - 1) * x), F.lit(0.0), lambda a, x: a + x) / (n * n)
    return rounded(rows.where("next is not null").select("asset", "pos", (near - spread).alias("crps")))


# aggregates over scored rows ------------------------------------------------


@query
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.summary(scored(spark, sf_dir)))


def _one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("horizon = 1")


@query
def kupiec(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = risk.hit_tests(risk.long_levels(_one_step(spark, sf_dir)))
    return rounded(t.select("asset", "model", "level", "n", "n_hits", "n_dropped", "hit_rate", "expected_hits", "small_sample", "lr_pof", "p_pof"))


@query
def christoffersen(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = risk.hit_tests(risk.long_levels(_one_step(spark, sf_dir)))
    return rounded(t.select("asset", "model", "level", "n00", "n01", "n10", "n11", "pi01", "pi11", "lr_uc", "lr_ind", "lr_cc", "p_uc", "p_ind", "p_cc"))


@query
def var_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = risk.hit_tests(risk.long_levels(_one_step(spark, sf_dir), policy="score"))
    return rounded(t.select("asset", "model", "level", "n", "n_hits", "n_dropped", "fz0_mean", "fz0_n"))


@query
def loss_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.loss_matrix(inference.losses(scored(spark, sf_dir), "qlike"), MODELS))


@query
def loss_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.ambiguous(inference.losses(scored(spark, sf_dir), "crps").withColumn("model", F.lit("any")))


@query
def dm_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.diebold_mariano(inference.losses(scored(spark, sf_dir), "crps")).drop("p_value", "n_dropped", "variance_nonpositive"))


@query
def dm_bartlett(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.diebold_mariano(inference.losses(scored(spark, sf_dir), "crps"), lag=3, kernel="bartlett", hln=False).drop("p_value", "n_dropped", "variance_nonpositive"))


@query
def dm_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.diebold_mariano(inference.losses(scored(spark, sf_dir), "crps")).select("asset", "horizon", "model_a", "model_b", "p_value"))


@query
def block_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = inference.losses(_one_step(spark, sf_dir), "crps").where("loss is not null")
    return rounded(inference.block_sums(long, 10))


@query
def vol_target_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = econ.path(_one_step(spark, sf_dir), BOOK)
    return rounded(p.select("asset", "model", "origin_index", "position", "turnover", "gross", "net", "equity", "drawdown", "ruined"))


@query
def vol_target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(econ.report(econ.path(_one_step(spark, sf_dir), BOOK), BOOK))


@query
def periods_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = daily(spark, sf_dir).select("asset").distinct().withColumn("asset", F.when(F.col("asset") == "A", "BTC-USD").otherwise(F.col("asset")))
    return a.select("asset", M.periods_per_year(F.col("asset")).alias("periods"))


@query
def fit_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("fit_status", F.when(F.col("fit_origin") % 5 == 0, "fallback=1|test").when(F.col("model") == "ewma", "ok").otherwise(""))
    return rounded(grid.outcomes(rows))


# grids and identity ---------------------------------------------------------


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.indexed(daily(spark, sf_dir), ["ewma", "naive", "har"], [1, 5], ["daily", "none"])


@query
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir)
    return grid.missing(c, c.where("cell % 3 = 0").select("cell"), ["cell"])


@query
def grid_scoped_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("asset", "model", "origin_index", "horizon")
    wanted = _cells(spark, sf_dir).where("arm = 'daily' and asset <> 'N'").select("asset", "model", "horizon").distinct()
    return rows.join(wanted, ["asset", "model", "horizon"], "left_semi").groupBy("asset", "model", "horizon").agg(F.count("*").alias("n_rows")).withColumn("horizon", F.col("horizon").cast("long"))


@query
def manifest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.rollup(_cells(spark, sf_dir).withColumn("status", F.when(F.col("cell") % 3 == 0, "cached").when(F.col("cell") % 7 == 0, "failed").otherwise("computed")))


@query
def config_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = identity.digests(series(spark, sf_dir), "ret").collect()  # one row an asset
    rows = [(r["asset"], m.name, identity.config_hash(identity.experiment(m, {"asset": r["asset"], "digest": r["digest"]}, SPLIT, 0, environment={}))) for r in digests for m in block.MODELS.values()]
    return spark.createDataFrame(rows, "asset string, model string, config_hash string")


# block models ---------------------------------------------------------------


def _block(name: str, *models) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(block_rows(spark, sf_dir, *models))

    run.__name__ = name
    query(run)


_block("model_garch", block.Garch())
_block("model_garch_t", block.Garch(student=True))
_block("model_gjr", block.Garch(asymmetric=True))
_block("model_har", block.Har())
_block("model_autoets", block.AutoEts())
_block("model_autoarima", block.AutoArima())
_block("model_gbm", block.BoostedTrees())
_block("model_zero_shot", block.ZeroShot())


@query
def block_naive_equals_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block runner on a model that also is a window expression."""
    rows = block_rows(spark, sf_dir, block.Naive(), block.Ewma(), split=SQL_SPLIT)
    return rounded(rows.select("asset", "model", "origin_index", "fit_origin", "conditioned_through", "forecast_var", "crps", "hit_0p05", "missing_reason"))


@query
def model_confidence_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.model_confidence_sets(inference.losses(_one_step(spark, sf_dir), "crps"), seed=1))


@query
def ppw_block_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.block_lengths(inference.losses(_one_step(spark, sf_dir), "crps")))


@query
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.comparison(inference.losses(_one_step(spark, sf_dir), "crps"), seed=1))


@query
def distribution_functionals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every functional of the four laws at fixed settings."""
    laws = [Distribution.normal(0.1, 1.5), Distribution.student_t(0.0, 1.0, 5.0), Distribution.samples([3.0, -1.0, 0.5, 2.0]), Distribution.quantiles([0.1, 0.5, 0.9], [-1.0, 0.0, 2.0])]
    rows = [(d.kind, a, d.quantile(a), d.cdf(0.3), d.crps(0.3), d.expected_shortfall(a), *d.moments(), float(d.sample(4, 7).mean())) for d in laws for a in M.LEVELS]
    return rounded(spark.createDataFrame(rows, "kind string, level double, quantile double, cdf double, crps double, es double, mean double, variance double, sampled double"))


# ----------------------------------------------------------------------------
# the same in SQL

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus"
_BARS = f"""bars AS (
  SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS ts, first(p ORDER BY {_ORDER}) AS open, max(p) AS high, min(p) AS low,
         last(p ORDER BY {_ORDER}) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0) GROUP BY 1, 2)"""
_RAW = f"""{_BARS}, raw AS (
  SELECT asset, ts, open, close, volume,
         CASE day(ts) WHEN 7 THEN high * (1 - 4e-6) WHEN 13 THEN high * 0.9 WHEN 17 THEN -high ELSE high END AS high,
         CASE day(ts) WHEN 21 THEN low * (1 + 4e-6) ELSE low END AS low FROM bars)"""
_REPAIRED = f"""{_RAW}, v AS (
  SELECT *, CASE WHEN high <= 0 OR low <= 0 THEN 'inf'::DOUBLE ELSE greatest((greatest(open, close) - high) / high, (low - least(open, close)) / low) END AS violation FROM raw
), repaired AS (
  SELECT asset, ts, open, close, volume, violation, high AS raw_high, low AS raw_low, violation > 0 AND violation <= 1e-5 AS clamped, violation > 1e-5 AS inconsistent,
         CASE WHEN violation > 0 AND violation <= 1e-5 THEN greatest(high, open, close) ELSE high END AS high,
         CASE WHEN violation > 0 AND violation <= 1e-5 THEN least(low, open, close) ELSE low END AS low FROM v)"""
_LN = lambda a, b: f"ln((CASE WHEN {a} > 0 THEN {a} END) / (CASE WHEN {b} > 0 THEN {b} END))"
_FORMULA = {
    "log_return": "ln(close) - lag(ln(close)) OVER w",
    "squared_return": "pow(ln(close) - lag(ln(close)) OVER w, 2)",
    "parkinson": f"pow({_LN('high', 'low')}, 2) / (4 * ln(2.0))",
    "garman_klass": f"0.5 * pow({_LN('high', 'low')}, 2) - (2 * ln(2.0) - 1) * pow({_LN('close', 'open')}, 2)",
    "rogers_satchell": f"{_LN('high', 'open')} * {_LN('high', 'close')} + {_LN('low', 'open')} * {_LN('low', 'close')}",
    "overnight_variance": "pow(ln(open / lag(close) OVER w), 2)",
}
_FORMULA["overnight_plus_range"] = f"{_FORMULA['overnight_variance']} + {_FORMULA['rogers_satchell']}"
_W = "WINDOW w AS (PARTITION BY asset ORDER BY ts)"
_TARGETS = f"""{_REPAIRED}, targets AS (
  SELECT *, {_FORMULA['log_return']} AS ret, {_FORMULA['squared_return']} AS squared_return,
         CASE WHEN NOT inconsistent THEN {_FORMULA['parkinson']} END AS parkinson, CASE WHEN NOT inconsistent THEN {_FORMULA['garman_klass']} END AS garman_klass,
         CASE WHEN NOT inconsistent THEN {_FORMULA['overnight_plus_range']} END AS overnight_plus_range FROM repaired {_W})"""
_SERIES = f"""{_TARGETS}, series AS (
  SELECT asset, ts, ret, overnight_plus_range AS proxy, greatest(squared_return, 1e-6) AS rv,
         row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY asset) AS n FROM targets WHERE ret IS NOT NULL)"""


def _origins(w: int, h: int, step: int, refit: int) -> str:
    return f"""{_SERIES}, origins AS (
  SELECT *, k % {refit} = 0 AS refit, k // {refit} AS block_id, (k // {refit}) * {refit * step} + {w - 1} AS fit_origin
  FROM (SELECT *, (pos - {w - 1}) // {step} AS k FROM series WHERE pos >= {w - 1} AND pos <= n - 1 - {h} AND (pos - {w - 1}) % {step} = 0))"""


_FC = f"""{_origins(100, 2, 1, 21)}, wide AS (
  SELECT asset, pos, count(ret) OVER f AS c, greatest(avg(ret * ret) OVER f, 1e-24) AS naive, list(ret * ret) OVER f AS l FROM series
  WINDOW f AS (PARTITION BY asset ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)
), forecasts AS (
  SELECT asset, pos, 'naive' AS model, naive AS forecast_var FROM wide WHERE c = 100 UNION ALL
  SELECT asset, pos, 'ewma', greatest(pow(0.94, 99) * l[1] + list_sum(list_transform(range(2, 101), lambda i: 0.06 * pow(0.94, 100 - i) * l[i])), 1e-24) FROM wide WHERE c = 100)"""
_PHI = "(0.5 + sign(z) * exp(-0.5 * z * z) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 130), lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-200)) - ((k + 1) * ln(2.0) + lgamma(k + 1.5) - 0.5 * ln(pi()))))))"
_LEVELS = [(a, M.level_tag(a), N.quantile_of(a), N.tail_mean_factor(a)) for a in M.LEVELS]
_SCORED = f"""{_FC}, s0 AS (
  SELECT o.asset, f.model, o.pos AS origin_index, h.horizon, o.pos + h.horizon AS target_index, o.fit_origin, o.pos AS conditioned_through, o.refit,
         0.0::DOUBLE AS forecast_mean, f.forecast_var, t.ret AS realized_return, t.proxy AS proxy_var, sqrt(f.forecast_var) AS s, t.ret / sqrt(f.forecast_var) AS z
  FROM origins o JOIN forecasts f ON f.asset = o.asset AND f.pos = o.pos CROSS JOIN (SELECT unnest([1, 2])::BIGINT AS horizon) h
  LEFT JOIN series t ON t.asset = o.asset AND t.pos = o.pos + h.horizon
), s1 AS (
  SELECT *, s * (z * (2 * {_PHI} - 1) + 2 * exp(-0.5 * z * z) / sqrt(2 * pi()) - 1 / sqrt(pi())) AS crps, 0.5 * ln(2 * pi()) + ln(s) + 0.5 * z * z AS log_score,
         CASE WHEN proxy_var > 0 THEN proxy_var / forecast_var - ln(proxy_var / forecast_var) - 1 END AS qlike,
         CASE WHEN proxy_var IS NULL THEN 'proxy_nan' WHEN proxy_var <= 0 THEN 'proxy_nonpositive' ELSE '' END AS missing_reason,
         {', '.join(f'{z!r} * s AS var_{t}, -{e!r} * s AS es_{t}' for _, t, z, e in _LEVELS)} FROM s0
), scored AS (
  SELECT *, {', '.join(f'greatest({a} * (realized_return - var_{t}), ({a} - 1) * (realized_return - var_{t})) AS pinball_{t}, (realized_return < var_{t})::INT::DOUBLE AS hit_{t}' for a, t, _, _ in _LEVELS)} FROM s1)"""


def _sql(name: str, ctes: str, body: str) -> None:
    ORACLE_SQL[name] = f"WITH {ctes}\n{body}" if ctes else body


def _r(*names: str, places: int = 5) -> str:
    return ", ".join(f"round({n}, {places}) + 0.0 AS {n}" for n in names)


_sql("bars_daily", _BARS, "SELECT asset, ts, open, high, low, close, volume FROM bars")
_MINUTES = "minutes AS (SELECT event_type AS asset, ts, value AS close FROM events WHERE value > 0)"
_sql("bars_5min", _MINUTES, "SELECT asset, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, arg_max(close, minutes.ts) AS close FROM minutes GROUP BY 1, 2")
_sql("bars_daily_from_minutes", _MINUTES, "SELECT asset, CAST(ts AS DATE) AS day, arg_min(close, ts) AS open, max(close) AS high, min(close) AS low, arg_max(close, ts) AS close, count(*)::DOUBLE AS volume FROM minutes GROUP BY 1, 2")
_sql("minute_dedupe", "", "SELECT event_type AS asset, date_trunc('hour', ts) AS ts, min(event_id) AS event_id, arg_min(value, event_id) AS close FROM events WHERE value > 0 GROUP BY 1, 2")
_RV = "SELECT asset, day, {cond} AS realized_variance, n_bars FROM (SELECT asset, day, sum(pow(r, 2)) AS s, count(*) AS n_bars FROM (SELECT asset, CAST(ts AS DATE) AS day, ln(close) - lag(ln(close)) OVER (PARTITION BY asset, CAST(ts AS DATE) ORDER BY ts) AS r FROM {src}) GROUP BY 1, 2)"
_BUCKET = lambda m: f"{_MINUTES}, b AS (SELECT asset, time_bucket(INTERVAL {m} MINUTE, ts) AS ts, arg_max(close, minutes.ts) AS close FROM minutes GROUP BY 1, 2)"
_sql("realized_variance", _MINUTES, _RV.format(src="minutes", cond="CASE WHEN n_bars >= 2 THEN round(coalesce(s, 0), 5) END"))
_sql("realized_variance_5min", _BUCKET(5), _RV.format(src="b", cond="CASE WHEN n_bars >= 12 THEN round(coalesce(s, 0), 5) END"))
_sql("rv_left_reindex", _BUCKET(60), f"SELECT d.asset, d.day, x.realized_variance FROM (SELECT DISTINCT asset, CAST(ts AS DATE) AS day FROM minutes) d LEFT JOIN ({_RV.format(src='b', cond='round(s, 5)')}) x ON x.asset = d.asset AND x.day = d.day AND x.n_bars >= 20")
for _name, _f in _FORMULA.items():
    _sql(_name, _BARS, f"SELECT asset, ts, round({_f}, 5) AS value FROM bars {_W}")
_sql("ohlc_check", _RAW, "SELECT asset, ts, low <= least(open, close) AND greatest(open, close) <= high AS consistent FROM raw")
_sql("ohlc_repair", _REPAIRED, "SELECT asset, ts, high, low, clamped, inconsistent FROM repaired")
_sql("bar_quality", _REPAIRED, "SELECT asset, count(*) AS n_bars, count(*) FILTER (inconsistent) AS n_inconsistent, count(*) FILTER (clamped) AS n_clamped, count(*) FILTER (raw_high = raw_low) AS n_zero_range, count(*) FILTER (raw_high <= 0 OR raw_low <= 0) AS n_nonpositive FROM repaired GROUP BY 1")
_sql("bar_validation", _BARS, "SELECT 'all' AS asset, ts, 'repeated time' AS reason FROM bars GROUP BY ts HAVING count(*) > 1")
_sql("targets_masked", _TARGETS, f"SELECT asset, ts, {_r('squared_return', 'parkinson', 'garman_klass', 'overnight_plus_range')} FROM targets")
_sql("targets_trimmed", _TARGETS, f"SELECT asset, ts, {_r('ret', 'overnight_plus_range')} FROM targets WHERE ts BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'")
_sql("invalid_mask", _TARGETS, "SELECT asset, ts, coalesce(overnight_plus_range > 0, false) AS valid FROM targets")
_sql("alignment_check", _TARGETS, "SELECT asset, min(ts) AS first_mismatch, count(*) AS n_mismatches FROM targets WHERE overnight_plus_range IS NULL GROUP BY 1")
_sql("calendar_gaps", _BARS, "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY gap_days DESC, before) AS rank FROM (SELECT asset, lag(ts) OVER w AS after, ts AS before, (ts - lag(ts) OVER w)::BIGINT AS gap_days FROM bars WINDOW w AS (PARTITION BY asset ORDER BY ts)) WHERE gap_days IS NOT NULL) WHERE rank <= 5")
_TAG = "CASE " + " ".join(f"WHEN {{d}} BETWEEN DATE '{r.start}' AND DATE '{r.end}' THEN '{r.tag}'" for r in REGIMES) + " ELSE 'calm' END"
_sql("crisis_tags", _BARS, f"SELECT asset, ts, {_TAG.format(d='ts')} AS regime, CASE {_TAG.format(d='ts')} WHEN 'calm' THEN 0 WHEN 'alpha' THEN 1 WHEN 'beta' THEN 2 ELSE 3 END::BIGINT AS regime_ord FROM bars")
_sql("crisis_table", _BARS, "SELECT asset, ts, " + ", ".join(f"(ts BETWEEN DATE '{r.start}' AND DATE '{r.end}')::BIGINT AS is_{r.tag}" for r in REGIMES) + " FROM bars")
_CRISES = "CASE " + " ".join(f"WHEN {{d}} BETWEEN DATE '{a}' AND DATE '{b}' THEN {{{k}}}" for k, (a, b) in enumerate([("2008-09-01", "2009-03-31"), ("2020-02-01", "2020-04-30"), ("2022-01-01", "2022-10-31"), ("2024-08-01", "2024-08-31")])) + " ELSE {4} END"
_DATED = _CRISES.format("'gfc'", "'covid'", "'tightening_2022'", "'spike_2024_08'", "'calm'", d="d")
_sql("dated_crises", f"{_BARS}, moved AS (SELECT asset, CAST(ts + INTERVAL 168 MONTH AS DATE) AS d FROM bars)", f"SELECT asset, d AS ts, {_DATED} AS regime, ({_CRISES.format(1, 2, 3, 4, 0, d='d')})::BIGINT AS regime_ord FROM moved")
_sql("supervised_windows", _SERIES, "SELECT a.asset, a.pos, round(sum(b.ret) FILTER (b.pos <= a.pos), 5) AS inputs, round(sum(b.ret) FILTER (b.pos > a.pos), 5) AS targets, round(arg_max(b.ret, b.pos), 5) AS last FROM series a JOIN series b ON b.asset = a.asset AND b.pos BETWEEN a.pos - 9 AND a.pos + 3 WHERE a.pos >= 9 AND a.pos + 3 < a.n GROUP BY 1, 2")
_sql("panel_build", _TARGETS, "SELECT t.asset, n_days, n_targets, n_bars, n_inconsistent, n_clamped, n_zero_range, n_nonpositive FROM (SELECT asset, count(*) AS n_days, count(overnight_plus_range) AS n_targets FROM targets WHERE ts BETWEEN DATE '1993-01-01' AND DATE '1996-12-31' GROUP BY 1) t JOIN (SELECT asset, count(*) AS n_bars, count(*) FILTER (inconsistent) AS n_inconsistent, count(*) FILTER (clamped) AS n_clamped, count(*) FILTER (raw_high = raw_low) AS n_zero_range, count(*) FILTER (raw_high <= 0 OR raw_low <= 0) AS n_nonpositive FROM repaired GROUP BY 1) q USING (asset)")
_sql("crisis_coverage", _origins(100, 2, 1, 21), f"SELECT s.asset, {_TAG.format(d='s.ts')} AS regime, count(*) AS available, count(t.pos)::BIGINT AS scored FROM series s LEFT JOIN (SELECT DISTINCT asset, pos + unnest([1, 2]) AS pos FROM origins) t ON t.asset = s.asset AND t.pos = s.pos GROUP BY 1, 2")
_sql("series_diagnostics", f"""{_TARGETS}, d AS (
  SELECT *, (ts - lag(ts) OVER w)::BIGINT AS gap, ln(open / lag(close) OVER w) AS on_r, ln(close / open) AS in_r FROM targets {_W}
), e AS (SELECT *, pow(on_r, 2) AS on_v, overnight_plus_range - pow(on_r, 2) AS in_v FROM d
), m AS (SELECT asset, avg(ret) AS m FROM e GROUP BY 1
), k AS (SELECT asset, avg(pow(ret - m, 2)) AS m2, avg(pow(ret - m, 3)) AS m3, avg(pow(ret - m, 4)) AS m4 FROM e JOIN m USING (asset) GROUP BY 1)""", f"""
SELECT e.asset, count(*) AS n_days, min(ts) AS first_day, max(ts) AS last_day, max(gap) AS max_gap, count(*) FILTER (gap > 4) AS n_long_gaps,
  round(avg(ret), 4) AS ret_mean, round(stddev_samp(ret), 4) AS ret_sd, round(any_value(m3 / pow(m2, 1.5)), 4) AS ret_skew, round(any_value(m4 / (m2 * m2) - 3), 4) AS ret_kurt,
  round(min(ret), 4) AS ret_min, round(max(ret), 4) AS ret_max, count(*) FILTER (ret = 0) AS n_zero_returns, count(*) FILTER (NOT coalesce(overnight_plus_range > 0, false)) AS n_invalid_targets,
  {', '.join(f'round(quantile_cont(overnight_plus_range, {q}), 4) AS target_q{round(100 * q):02d}' for q in diagnostics.QUANTILES)},
  round(avg(overnight_plus_range), 4) AS target_mean, round(avg(parkinson), 4) AS parkinson_mean, round(avg(garman_klass), 4) AS garman_klass_mean,
  round(sum(on_v) FILTER (in_v IS NOT NULL) / sum(on_v + in_v), 4) AS overnight_share, count(*) FILTER (on_r IS NOT NULL AND in_r IS NOT NULL) AS n_paired,
  count(*) FILTER (inconsistent) AS n_inconsistent, round(stddev_samp(ret) * sqrt(252.0), 4) AS annual_vol,
  round(var_samp(on_r) / (var_samp(on_r) + var_samp(in_r) FILTER (on_r IS NOT NULL)), 4) AS realized_overnight_share,
  round((var_samp(on_r) + var_samp(in_r) FILTER (on_r IS NOT NULL)) / var_samp(on_r + in_r), 4) AS decomposition_ratio
FROM e JOIN k USING (asset) GROUP BY 1""")
_sql("origins", _origins(50, 2, 3, 4), "SELECT asset, pos, k, refit, block_id, fit_origin FROM origins")
_sql("n_splits", _origins(50, 2, 3, 4), "SELECT s.asset, count(o.pos) AS n_splits FROM series s LEFT JOIN origins o ON o.asset = s.asset AND o.pos = s.pos GROUP BY 1")
_sql("refit_blocks", _origins(100, 2, 1, 21), "SELECT asset, block_id, count(*) AS n_origins, min(pos) AS first_origin, max(pos) AS last_origin FROM origins GROUP BY 1, 2")
_sql("train_windows", _SERIES, "SELECT a.asset, a.pos, count(*) AS n_train, round(sum(b.ret), 5) AS total, round(arg_min(b.ret, b.pos), 5) AS oldest FROM series a JOIN series b ON b.asset = a.asset AND b.pos BETWEEN a.pos - 19 AND a.pos WHERE a.pos >= 19 GROUP BY 1, 2")
_sql("target_explosion", _origins(100, 2, 1, 21), "SELECT o.asset, o.pos AS origin_index, h.horizon, o.pos + h.horizon AS target_index, round(t.ret, 5) AS realized_return, round(t.proxy, 5) AS proxy_var FROM origins o CROSS JOIN (SELECT unnest([1, 2])::BIGINT AS horizon) h LEFT JOIN series t ON t.asset = o.asset AND t.pos = o.pos + h.horizon")
_COMPACT = f"""{_SERIES}, c AS (SELECT asset, pos, coalesce(proxy > 0, false) AS valid FROM series
), g AS (SELECT asset, pos, row_number() OVER (PARTITION BY asset ORDER BY pos) AS rank FROM c WHERE valid
), u AS (SELECT asset, pos, count(*) FILTER (valid) OVER (PARTITION BY asset ORDER BY pos) AS n_valid FROM c
), windows AS (
  SELECT u.asset, u.pos, u.n_valid, a.pos AS first_pos, CASE WHEN a.pos IS NOT NULL THEN b.pos END AS last_pos, b.pos - a.pos + 1 - {COMPACT} AS n_dropped,
         CASE WHEN a.pos IS NULL THEN 'insufficient_history' ELSE '' END AS failure
  FROM u LEFT JOIN g b ON b.asset = u.asset AND b.rank = u.n_valid LEFT JOIN g a ON a.asset = u.asset AND a.rank = u.n_valid - {COMPACT - 1})"""
_sql("compaction_windows", _COMPACT, "SELECT asset, pos, n_valid, coalesce(first_pos, -1) AS first_pos, coalesce(last_pos, -1) AS last_pos, coalesce(n_dropped, -1) AS n_dropped, failure FROM windows")
_sql("dropped_positions", _COMPACT, "SELECT w.asset, w.pos, c.pos AS dropped FROM windows w JOIN c ON c.asset = w.asset AND NOT c.valid AND c.pos BETWEEN w.first_pos AND w.last_pos")
_sql("naive_forecast", _FC, "SELECT asset, pos, round(forecast_var, 5) AS forecast_var FROM forecasts WHERE model = 'naive'")
_sql("ewma_forecast", _FC, "SELECT asset, pos, round(forecast_var, 5) AS forecast_var FROM forecasts WHERE model = 'ewma'")
_MEAN = lambda n: f"CASE WHEN pos >= {n - 1} THEN avg(rv) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
_sql("har_features", _SERIES, f"SELECT asset, pos, round(rv, 5) AS rv_d, round({_MEAN(5)}, 5) AS rv_w, round({_MEAN(22)}, 5) AS rv_m FROM series")
_sql("lag_features", _SERIES, "SELECT asset, pos, " + ", ".join(f"round(lag(ln(rv), {k}) OVER (PARTITION BY asset ORDER BY pos), 5) AS lag_{k}" for k in range(22)) + f", round(ln({_MEAN(5)}), 5) AS log_w, round(ln({_MEAN(22)}), 5) AS log_m FROM series")
_VALUES = ["forecast_mean", "forecast_var", "realized_return", "proxy_var", "crps", "log_score", "qlike", *(f"{k}_{t}" for _, t, _, _ in _LEVELS for k in ("var", "es", "pinball", "hit"))]
_sql("scored_rows", _SCORED, f"SELECT asset, model, origin_index, horizon, target_index, fit_origin, conditioned_through, refit, missing_reason, {_r(*_VALUES)} FROM scored")
for _name, _columns in SCORED_VIEWS.items():
    _sql(_name, _SCORED, "SELECT asset, model, origin_index, horizon, " + (_r(*_columns) if _name != "missing_reason" else "missing_reason") + " FROM scored")
_sql("held_forecasts", _FC, "SELECT o.asset, f.model, o.pos AS origin_index, h.horizon, o.fit_origin, o.fit_origin AS conditioned_through, round(f.forecast_var, 5) AS forecast_var FROM origins o JOIN forecasts f ON f.asset = o.asset AND f.pos = o.fit_origin CROSS JOIN (SELECT unnest([1, 2])::BIGINT AS horizon) h")
_sql("mse", _SCORED, "SELECT asset, model, round(avg(pow(forecast_var - proxy_var, 2)), 3) AS mse FROM scored GROUP BY 1, 2")
_FZ0 = lambda a, t: f"(CASE WHEN realized_return <= var_{t} THEN (realized_return - var_{t}) / ({a} * es_{t}) ELSE 0 END + var_{t} / es_{t} + ln(-es_{t}) - 1)"
_sql("fz0", _SCORED, f"SELECT asset, model, origin_index, horizon, round({_FZ0(0.05, '0p05')}, 5) AS fz0 FROM scored")
_sql("level_tags", "", "SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, '{t}', {round(z, 9)}::DOUBLE)" for a, t, z, _ in _LEVELS) + ") x(level, tag, z)")
_sql("empirical_scores", f"{_SERIES}, t AS (SELECT asset, pos, lead(ret) OVER (PARTITION BY asset ORDER BY pos) AS next, list(ret) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS v FROM series)", "SELECT asset, pos, round(list_avg(list_transform(v, lambda x: abs(x - next))) - list_sum(list_transform(v, lambda x: list_sum(list_transform(v, lambda y: abs(x - y))))) / 5000, 5) AS crps FROM t WHERE pos >= 49 AND next IS NOT NULL")
_sql("score_summary", _SCORED, "SELECT model, count(*) AS n, count(crps) AS n_scored, round(avg(crps), 5) AS crps, round(avg(log_score), 5) AS log_score, round(avg(qlike), 5) AS qlike, round(avg(s), 5) AS mean_vol, " + ", ".join(f"round(avg(hit_{t}), 5) AS hit_{t}" for _, t, _, _ in _LEVELS) + " FROM scored GROUP BY 1")
_XL = lambda x, y: f"(CASE WHEN {x} = 0 THEN 0 ELSE {x} * ln({y}) END)"


def _hits(policy: str) -> str:
    hit = lambda t: f"CASE WHEN missing_reason = '' THEN hit_{t} END" if policy == "flagged" else f"hit_{t}"
    parts = " UNION ALL ".join(f"SELECT asset, model, origin_index, {a}::DOUBLE AS level, {hit(t)} AS hit, {_FZ0(a, t)} AS fz0 FROM scored WHERE horizon = 1" for a, t, _, _ in _LEVELS)
    return f"""{_SCORED}, long AS ({parts}), c AS (
  SELECT asset, model, level, count(hit) AS n, coalesce(sum(hit), 0)::BIGINT AS n_hits, count(*) FILTER (hit IS NULL) AS n_dropped,
         {', '.join(f'count(*) FILTER (prev = {i} AND hit = {j}) AS n{i}{j}' for i in (0, 1) for j in (0, 1))}, avg(fz0) FILTER (hit IS NOT NULL) AS fz0_mean, count(fz0) FILTER (hit IS NOT NULL) AS fz0_n
  FROM (SELECT *, lag(hit) OVER (PARTITION BY asset, model, level ORDER BY origin_index) AS prev FROM long) GROUP BY 1, 2, 3
), q AS (
  SELECT *, n_hits / n AS hit_rate, n * level AS expected_hits, n * level < 10 AS small_sample, coalesce(n01 / nullif(n00 + n01, 0), 0) AS pi01, coalesce(n11 / nullif(n10 + n11, 0), 0) AS pi11, (n01 + n11) / (n00 + n01 + n10 + n11) AS pi FROM c
), lr AS (
  SELECT *, greatest(0, 2 * ({_XL('(n - n_hits)', '(1 - hit_rate)')} + {_XL('n_hits', 'hit_rate')} - {_XL('(n - n_hits)', '(1 - level)')} - {_XL('n_hits', 'level')})) AS lr_pof,
         greatest(0, 2 * ({_XL('(n00 + n10)', '(1 - pi)')} + {_XL('(n01 + n11)', 'pi')} - {_XL('(n00 + n10)', '(1 - level)')} - {_XL('(n01 + n11)', 'level')})) AS lr_uc,
         greatest(0, 2 * ({_XL('n00', '(1 - pi01)')} + {_XL('n01', 'pi01')} + {_XL('n10', '(1 - pi11)')} + {_XL('n11', 'pi11')} - {_XL('(n00 + n10)', '(1 - pi)')} - {_XL('(n01 + n11)', 'pi')})) AS lr_ind FROM q)"""


def _chi1(x: str) -> str:
    return f"(SELECT 2 * (1 - {_PHI}) FROM (SELECT sqrt({x}) AS z))"


_TESTS = "SELECT asset, model, level, {columns} FROM (SELECT *, lr_uc + lr_ind AS lr_cc FROM lr)"
_sql("kupiec", _hits("flagged"), _TESTS.format(columns=f"n, n_hits, n_dropped, {_r('hit_rate', 'expected_hits')}, small_sample, round(lr_pof, 5) AS lr_pof, round({_chi1('lr_pof')}, 5) AS p_pof"))
_sql("christoffersen", _hits("flagged"), _TESTS.format(columns=f"n00, n01, n10, n11, {_r('pi01', 'pi11', 'lr_uc', 'lr_ind', 'lr_cc')}, round({_chi1('lr_uc')}, 5) AS p_uc, round({_chi1('lr_ind')}, 5) AS p_ind, round(exp(-lr_cc / 2), 5) AS p_cc"))
_sql("var_backtest", _hits("score"), "SELECT asset, model, level, n, n_hits, n_dropped, round(fz0_mean, 5) AS fz0_mean, fz0_n FROM c")
_LOSS = lambda score: f"{_SCORED}, losses AS (SELECT asset, horizon, origin_index, model, CASE WHEN missing_reason = '' THEN {score} END AS loss FROM scored)"
_sql("loss_matrix", _LOSS("qlike"), "SELECT asset, horizon, origin_index, round(max(loss) FILTER (model = 'ewma'), 5) AS ewma, round(max(loss) FILTER (model = 'naive'), 5) AS naive FROM losses GROUP BY 1, 2, 3")
_sql("loss_ambiguity", _LOSS("crps"), "SELECT asset, horizon, origin_index, 'any' AS model, count(*) AS n FROM losses GROUP BY 1, 2, 3 HAVING count(*) > 1")


def _dm(lag: str, weight: str, factor: str) -> tuple[str, str]:
    ctes = f"""{_LOSS('crps')}, d AS (
  SELECT a.asset, a.horizon, a.model AS model_a, b.model AS model_b, a.origin_index, a.loss - b.loss AS d
  FROM losses a JOIN losses b ON a.asset = b.asset AND a.horizon = b.horizon AND a.origin_index = b.origin_index AND a.model <> b.model WHERE a.loss IS NOT NULL AND b.loss IS NOT NULL
), e AS (SELECT *, d - avg(d) OVER p AS e, row_number() OVER (p ORDER BY origin_index) AS t, count(*) OVER p AS n, avg(d) OVER p AS m, {lag} AS lags FROM d WINDOW p AS (PARTITION BY asset, horizon, model_a, model_b)
), g AS (SELECT x.asset, x.horizon, x.model_a, x.model_b, x.t - y.t AS k, sum(x.e * y.e) / any_value(x.n) AS gamma, any_value(x.n) AS n, any_value(x.m) AS m, any_value(x.lags) AS lags
  FROM e x JOIN e y ON x.asset = y.asset AND x.horizon = y.horizon AND x.model_a = y.model_a AND x.model_b = y.model_b AND y.t BETWEEN x.t - x.lags AND x.t GROUP BY 1, 2, 3, 4, 5
), lr_var AS (SELECT asset, horizon, model_a, model_b, any_value(n) AS n, any_value(m) AS mean_diff, any_value(lags) + 1 AS h, sum(CASE WHEN k = 0 THEN gamma ELSE 2 * {weight} * gamma END) / any_value(n) AS variance FROM g GROUP BY 1, 2, 3, 4)"""
    return ctes, f"SELECT asset, horizon, model_a, model_b, n, {_r('mean_diff', 'variance')}, round({factor} * mean_diff / sqrt(variance), 5) AS statistic FROM lr_var"


_sql("dm_matrix", *_dm("horizon - 1", "1", "sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)"))
_sql("dm_bartlett", *_dm("3", "(1 - k / 4)", "1"))
_sql("block_sums", _LOSS("crps"), "SELECT asset, model, t, round(s, 5) AS block_sum FROM (SELECT asset, model, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY asset, model) AS n, sum(loss) OVER (w ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s FROM losses WHERE horizon = 1 AND loss IS NOT NULL WINDOW w AS (PARTITION BY asset, model ORDER BY origin_index)) WHERE t + 10 <= n")
_BOOK = f"""{_SCORED}, p0 AS (
  SELECT asset, model, origin_index, least(0.10 / sqrt(252.0) / (sqrt(forecast_var) * 0.01), 2.0) AS position, coalesce(exp(realized_return * 0.01) - 1, 0) AS simple FROM scored WHERE horizon = 1
), p1 AS (SELECT *, position * simple AS gross, abs(position - coalesce(lag(position) OVER w, 0)) AS turnover FROM p0 WINDOW w AS (PARTITION BY asset, model ORDER BY origin_index)
), p2 AS (SELECT *, gross - turnover * 0.001 AS net FROM p1
), p3 AS (SELECT *, bool_or(net <= -1) OVER w AS ruined, CASE WHEN bool_or(net <= -1) OVER w THEN 0 ELSE exp(sum(CASE WHEN net > -1 THEN ln(1 + net) ELSE 0 END) OVER w) END AS equity FROM p2 WINDOW w AS (PARTITION BY asset, model ORDER BY origin_index)
), path AS (SELECT *, 1 - equity / greatest(1.0, max(equity) OVER (PARTITION BY asset, model ORDER BY origin_index)) AS drawdown FROM p3)"""
_sql("vol_target_path", _BOOK, f"SELECT asset, model, origin_index, {_r('position', 'turnover', 'gross', 'net', 'equity', 'drawdown')}, ruined FROM path")
_sql("vol_target_summary", _BOOK, """SELECT asset, model, count(*) AS n_periods, count(*) FILTER (position = 0) AS n_flat, 252.0::DOUBLE AS periods_per_year,
  round(CASE WHEN arg_max(equity, origin_index) <= 0 THEN -1 ELSE pow(arg_max(equity, origin_index), 252.0 / count(*)) - 1 END, 5) AS annual_return, round(stddev_samp(net) * sqrt(252.0), 5) AS annual_vol,
  round(avg(net) / stddev_samp(net) * sqrt(252.0), 5) AS sharpe, round(avg(gross) / stddev_samp(gross) * sqrt(252.0), 5) AS gross_sharpe, round(greatest(max(drawdown), 0), 5) AS max_drawdown,
  round(avg(position), 5) AS avg_leverage, round(avg(turnover), 5) AS avg_daily_turnover, round(avg(turnover) * 252, 5) AS annual_turnover, round(avg(turnover) * 0.001 * 252, 5) AS annual_cost_drag, bool_or(ruined) AS ruined FROM path GROUP BY 1, 2""")
_sql("periods_per_year", _BARS, "SELECT DISTINCT CASE WHEN asset = 'A' THEN 'BTC-USD' ELSE asset END AS asset, CASE WHEN asset = 'A' THEN 365.0 ELSE 252.0 END::DOUBLE AS periods FROM bars")
_sql("fit_status_counts", f"{_SCORED}, f AS (SELECT asset, model, fit_origin, max(CASE WHEN fit_origin % 5 = 0 THEN 'fallback' WHEN model = 'ewma' THEN 'ok' ELSE '' END) AS s FROM scored GROUP BY 1, 2, 3)", """
SELECT n.asset, n.model, n_rows, n_missing, n_fits, n_reported, 0::BIGINT AS n_nonconverged, n_fallback, round(n_fallback / nullif(n_reported, 0), 5) AS fallback_rate
FROM (SELECT asset, model, count(*) AS n_rows, count(*) FILTER (missing_reason <> '') AS n_missing FROM scored GROUP BY 1, 2) n
JOIN (SELECT asset, model, count(*) AS n_fits, count(*) FILTER (s <> '') AS n_reported, count(*) FILTER (s = 'fallback') AS n_fallback FROM f GROUP BY 1, 2) x ON x.asset = n.asset AND x.model = n.model""")
_CELLS = f"""{_BARS}, cells AS (SELECT *, row_number() OVER (ORDER BY asset, model, horizon, arm) - 1 AS cell FROM (SELECT DISTINCT asset FROM bars) CROSS JOIN (VALUES ('ewma'), ('naive'), ('har')) m(model) CROSS JOIN (VALUES (1::BIGINT), (5::BIGINT)) h(horizon) CROSS JOIN (VALUES ('daily'), ('none')) a(arm))"""
_sql("grid_cells", _CELLS, "SELECT * FROM cells")
_sql("resume_anti", _CELLS, "SELECT * FROM cells WHERE cell % 3 <> 0")
_sql("grid_scoped_read", _FC, "SELECT o.asset, f.model, 1::BIGINT AS horizon, count(*) AS n_rows FROM origins o JOIN forecasts f ON f.asset = o.asset AND f.pos = o.pos WHERE o.asset <> 'N' GROUP BY 1, 2")
_sql("manifest_rollup", _CELLS, "SELECT CASE WHEN cell % 3 = 0 THEN 'cached' WHEN cell % 7 = 0 THEN 'failed' ELSE 'computed' END AS status, count(*) AS n_cells FROM cells GROUP BY 1")
_NATIVE_BLOCKS = f"""{_origins(250, 1, 5, 21)}, wide AS (
  SELECT asset, pos, count(ret) OVER f AS c, greatest(avg(ret * ret) OVER f, 1e-24) AS naive, list(ret * ret) OVER f AS l FROM series WINDOW f AS (PARTITION BY asset ORDER BY pos ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)
), forecasts AS (
  SELECT asset, pos, 'naive' AS model, naive AS forecast_var FROM wide WHERE c = 250 UNION ALL
  SELECT asset, pos, 'ewma', pow(0.94, 249) * l[1] + list_sum(list_transform(range(2, 251), lambda i: 0.06 * pow(0.94, 250 - i) * l[i])) FROM wide WHERE c = 250
), x AS (SELECT o.asset, f.model, o.pos AS origin_index, o.fit_origin, f.forecast_var, sqrt(f.forecast_var) AS s, t.ret, t.proxy, t.ret / sqrt(f.forecast_var) AS z FROM origins o JOIN forecasts f ON f.asset = o.asset AND f.pos = o.pos JOIN series t ON t.asset = o.asset AND t.pos = o.pos + 1)"""
_sql("block_naive_equals_native", _NATIVE_BLOCKS, f"SELECT asset, model, origin_index, fit_origin, origin_index AS conditioned_through, round(forecast_var, 5) AS forecast_var, round(s * (z * (2 * {_PHI} - 1) + 2 * exp(-0.5 * z * z) / sqrt(2 * pi()) - 1 / sqrt(pi())), 5) AS crps, (ret < {N.quantile_of(0.05)!r} * s)::INT::DOUBLE AS hit_0p05, CASE WHEN proxy IS NULL THEN 'proxy_nan' WHEN proxy <= 0 THEN 'proxy_nonpositive' ELSE '' END AS missing_reason FROM x")
