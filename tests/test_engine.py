"""Bars, positions, scores, risk, inference, models and store on small inputs."""

import json
import math
import zipfile
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oriel.functions import metrics as M
from oriel.functions import normal as N
from oriel.functions import special
from oriel.functions.dist import Distribution, rearranged
from oriel.models import block, native
from oriel.operators import bars, econ, inference, positions, regimes, risk, scoring
from oriel.plans import backtest, grid, identity
from oriel.sources import files, synthetic
from oriel.sources.store import ResultsStore


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    rows = []
    for asset in ("X", "Y"):
        r = rng.normal(0, 0.01, 160)
        for k, v in enumerate(r):
            rows.append((asset, datetime(2020, 1, 1) + pd.Timedelta(days=k).to_pytimedelta(), float(v), float(v * v if k % 17 else 0.0), float(max(v * v, 1e-8))))
    df = spark.createDataFrame(rows, "asset string, ts timestamp, ret double, proxy double, rv double")
    return positions.positioned(df).cache()


def test_bars_and_repair(spark):
    t = spark.createDataFrame([("A", datetime(2024, 1, 1, 0, m), float(p)) for m, p in ((0, 10), (3, 12), (7, 9), (9, 11))], "asset string, ts timestamp, close double")
    assert [r["close"] for r in bars.sampled(t, 5).orderBy("ts").collect()] == [12.0, 11.0]
    with pytest.raises(ValueError):
        bars.sampled(t, 7)
    rv = bars.realized_variance(t).first()
    assert rv["realized_variance"] == pytest.approx(sum(math.log(b / a) ** 2 for a, b in ((10, 12), (12, 9), (9, 11))))
    raw = spark.createDataFrame([("A", date(2024, 1, 1), 10.0, 10.0 * (1 - 5e-6), 9.0, 9.5), ("A", date(2024, 1, 2), 10.0, 9.0, 8.0, 9.5), ("A", date(2024, 1, 3), 1.0, 0.0, 0.0, 1.0)], "asset string, ts date, open double, high double, low double, close double")
    got = bars.repaired(raw).orderBy("ts").collect()
    assert [r["clamped"] for r in got] == [True, False, False] and got[0]["high"] == 10.0
    assert [r["inconsistent"] for r in got] == [False, True, True]
    q = bars.quality(bars.repaired(raw)).first()
    assert (q["n_bars"], q["n_clamped"], q["n_inconsistent"], q["n_zero_range"], q["n_nonpositive"]) == (3, 1, 2, 1, 1)


@pytest.mark.parametrize("window,horizon,step,refit", [(2, 1, 1, 1), (5, 5, 3, 4), (50, 1, 3, 1)])
def test_origins(series, window, horizon, step, refit):
    s = positions.Splitter(window, horizon, step, refit)
    got = positions.origins(series.where("asset = 'X'"), s).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(window - 1, 160 - horizon, step)) and len(got) == s.n_splits(160)
    assert all(r["refit"] == (r["k"] % refit == 0) and r["fit_origin"] <= r["pos"] for r in got)


def test_compaction_equals_brute_force(series):
    rows = series.withColumn("valid", F.col("proxy") > 0)
    got = positions.compaction(rows, "valid", 20).where("asset = 'X'").orderBy("pos").collect()
    valid = [r["pos"] for r in rows.where("asset = 'X' and valid").orderBy("pos").collect()]
    for r in got:
        upto = [p for p in valid if p <= r["pos"]][-20:]
        if len(upto) < 20:
            assert r["failure"] == "insufficient_history" and r["last_pos"] is None
        else:
            assert (r["first_pos"], r["last_pos"], r["n_dropped"]) == (upto[0], upto[-1], upto[-1] - upto[0] - 19)


def test_future_never_leaks(series):
    """Poison after a time leaves forecasts up to it untouched; poison before it does not."""
    s = positions.Splitter(30)
    base = {(r["asset"], r["pos"]): r["v"] for r in series.select("asset", "pos", native.weighted_variance("ret", 30).alias("v")).collect()}
    late = series.withColumn("ret", F.when(F.col("pos") > 100, 9.0).otherwise(F.col("ret")))
    got = {(r["asset"], r["pos"]): r["v"] for r in late.select("asset", "pos", native.weighted_variance("ret", 30).alias("v")).collect()}
    assert all(got[k] == v for k, v in base.items() if k[1] <= 100) and any(got[k] != v for k, v in base.items() if k[1] > 100)
    rows = backtest.block_scores(late, [block.Naive()], s, "ret", "proxy").where("origin_index <= 100").select("asset", "origin_index", "forecast_var").collect()
    frame = {(r["asset"], r["pos"]): r["v"] for r in series.select("asset", "pos", native.trailing_variance("ret", 30).alias("v")).collect()}
    assert rows and all(r["forecast_var"] == pytest.approx(frame[r["asset"], r["origin_index"]]) for r in rows)


def test_normal_functions(spark):
    z = [-9.0, -4.2, -1.0, 0.0, 0.3, 2.0, 6.9, 8.0]
    df = spark.createDataFrame([(x,) for x in z], "z double")
    for r in df.select("z", N.cumulative(F.col("z")).alias("p"), N.crps(F.col("z"), F.lit(1.0)).alias("c")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / math.sqrt(2)), abs=1e-13)
        assert r["c"] == pytest.approx(Distribution.normal(0, 1).crps(r["z"]), abs=1e-12)


def test_distributions():
    n, t = Distribution.normal(0.1, 2.0), Distribution.student_t(0.0, 1.5, 5.0)
    e, q = Distribution.samples([3.0, -1.0, 0.5, 2.0]), Distribution.quantiles([0.1, 0.5, 0.9], [-1.0, 0.0, 2.0])
    assert t.cdf(t.quantile(0.025)) == pytest.approx(0.025) and special.t_ppf(0.975, 10) == pytest.approx(2.2281388, abs=1e-6)
    for d in (n, t, e, q):
        assert d.expected_shortfall(0.05) <= d.quantile(0.05) + 1e-12
        assert Distribution.of(d.row()).quantile(0.3) == d.quantile(0.3)
        assert d.sample(5, 1).tolist() == d.sample(5, 1).tolist()
    for d in (n, t):
        assert d.expected_shortfall(0.05) == pytest.approx(d.expected_shortfall_numeric(0.05), rel=2e-3)
        x = np.sort(np.random.default_rng(1).permutation([d.quantile((i + 0.5) / 4000) for i in range(4000)]))
        assert d.crps(0.7) == pytest.approx(Distribution.samples(x).crps(0.7), abs=5e-3)
    v = e.vals
    assert e.crps(1.0) == pytest.approx(np.abs(v - 1).mean() - np.abs(v[:, None] - v[None]).mean() / 2)
    for bad in (lambda: Distribution.normal(0, 0), lambda: Distribution.samples([]), lambda: Distribution.quantiles([0.5, 0.4], [0, 1]), lambda: n.quantile(1.0), lambda: Distribution.student_t(0, 1, 2).variance()):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(NotImplementedError):
        e.log_score(0)
    assert rearranged([1.0, 3.0, 2.0])[1] == 1 and M.level_tag(0.025) == "0p025"


def test_kupiec_and_christoffersen(spark):
    hits = [0, 0, 1, 0, None, 1, 1, 0, 0, 0]
    rows = spark.createDataFrame([("X", "m", i, 0.0, "", 0.05, None if h is None else float(h), -1.0, -2.0) for i, h in enumerate(hits)], "asset string, model string, origin_index long, realized_return double, missing_reason string, level double, hit double, var double, es double")
    r = risk.hit_tests(rows).first()
    lr, p = risk.kupiec(9, 3, 0.05)
    assert (r["n"], r["n_hits"], r["n_dropped"]) == (9, 3, 1) and r["lr_pof"] == pytest.approx(lr) and r["p_pof"] == pytest.approx(p, abs=1e-12)
    assert (r["n00"], r["n01"], r["n10"], r["n11"]) == (3, 1, 2, 1)  # no transition across the gap


def test_fz0_domain(spark):
    df = spark.createDataFrame([(-3.0, -1.0, -2.0), (0.0, -1.0, 0.5), (0.0, -2.0, -1.0)], "y double, v double, e double")
    a, b, c = (r["x"] for r in df.select(M.fz0(F.col("y"), F.col("v"), F.col("e"), 0.05, strict=False).alias("x")).collect())
    with pytest.raises(Exception, match="below 0"):
        df.select(M.fz0(F.col("y"), F.col("v"), F.col("e"), 0.05)).collect()
    assert a == pytest.approx(2 / (0.05 * 2) + 0.5 + math.log(2) - 1) and b is None and c is None


def test_missing_reasons(spark):
    df = spark.createDataFrame([(1.0, 0.1, 1.0), (None, None, None), (1.0, 0.1, 0.0), (0.0, 0.1, float("inf"))], "forecast_var double, realized_return double, proxy_var double")
    assert [r["x"] for r in df.select(scoring.reasons().alias("x")).collect()] == ["", "forecast_var_nonpositive|proxy_nan|target_nan", "proxy_nonpositive", "forecast_var_nonpositive|proxy_not_finite"]


def test_diebold_mariano_by_hand(spark):
    rng = np.random.default_rng(2)
    a, b = rng.gamma(2, size=60), rng.gamma(2, size=60)
    rows = [("X", 2, i, m, float(x[i]) if i != 7 or m == "b" else None) for m, x in (("a", a), ("b", b)) for i in range(60)]
    long = spark.createDataFrame(rows, "asset string, horizon int, origin_index long, model string, loss double")
    r = inference.diebold_mariano(long).where("model_a = 'a'").first()
    d = np.delete(a - b, 7)
    e, n, h = d - d.mean(), 59, 2
    v = (e @ e / n + 2 * (e[1:] @ e[:-1]) / n) / n
    stat = math.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n) * d.mean() / math.sqrt(v)
    assert r["n"] == 59 and r["statistic"] == pytest.approx(stat) and r["p_value"] == pytest.approx(2 * special.t_cdf(-abs(stat), 58))


def test_bootstrap_and_confidence_set():
    x = np.random.default_rng(0).normal(size=(50, 3))
    i = inference.block_indices(50, 7, 300, seed=4)
    assert i.shape == (300, 50) and np.allclose(x[i].mean(axis=1), inference.bootstrap_means(x, 7, 300, seed=4))
    y = np.random.default_rng(1).normal(size=(300, 3)) * 0.1 + np.array([0.0, 0.0, 1.0])
    for statistic in ("range", "max"):
        r = inference.confidence_set(y, seed=1, n_boot=500, statistic=statistic)
        assert r["order"][0] == 2 and r["included"] == [True, True, False]
    same = np.tile(np.random.default_rng(1).normal(size=(40, 1)), (1, 2))
    assert inference.confidence_set(same, seed=1, n_boot=100)["p"] == [1.0, 1.0]
    assert inference.automatic_block_length(np.ones(50)) == 1.0
    e = np.random.default_rng(3).normal(size=400)
    slow = np.array([e[: k + 1][::-1] @ 0.9 ** np.arange(k + 1) for k in range(400)])
    assert inference.automatic_block_length(slow) > inference.automatic_block_length(e)


def test_vol_target_book(spark):
    rows = [("X", "m", i, v, r) for i, (v, r) in enumerate([(1e-4, 0.01), (None, 0.02), (1e-8, -0.8), (1e-4, 0.05)])]
    df = spark.createDataFrame(rows, "asset string, model string, origin_index long, forecast_var double, realized_return double")
    p = econ.path(df).orderBy("origin_index").collect()
    assert p[1]["position"] == 0.0 and p[2]["position"] == 2.0  # capped
    assert p[0]["turnover"] == p[0]["position"] and p[2]["ruined"] and p[3]["equity"] == 0.0 and p[3]["drawdown"] == 1.0
    assert econ.report(econ.path(df)).first()["annual_return"] == -1.0


def test_regimes(spark):
    days = spark.createDataFrame([(date(*d),) for d in ((2008, 8, 31), (2008, 9, 1), (2009, 3, 31), (2009, 4, 1), (2020, 2, 1), (2020, 4, 30), (2022, 1, 1), (2022, 10, 31), (2024, 8, 5), (2024, 9, 1))], "d date")
    assert [r["t"] for r in days.select(regimes.tag_of(F.col("d")).alias("t")).collect()] == ["calm", "gfc", "gfc", "calm", "covid", "covid", "tightening_2022", "tightening_2022", "spike_2024_08", "calm"]
    with pytest.raises(ValueError):
        regimes.checked((regimes.Regime("a", date(2020, 1, 1), date(2020, 2, 1)), regimes.Regime("b", date(2020, 2, 1), date(2020, 3, 1))))
    with pytest.raises(KeyError):
        regimes.regime_by_tag("stress_2025_26")


def garch_path(n, seed, nu=None):
    rng, v, out = np.random.default_rng(seed), 1.0, []
    for _ in range(n):
        e = rng.normal() if nu is None else rng.standard_t(nu) * math.sqrt((nu - 2) / nu)
        out.append(math.sqrt(v) * e)
        v = 0.05 + 0.1 * out[-1] ** 2 + 0.85 * v
    return np.array(out)


def test_block_models():
    r = garch_path(1500, 1)
    g = block.Garch().fit(r)
    assert str(g.status) == "ok" and g.params[1] == pytest.approx(0.1, abs=0.05) and g.params[3] == pytest.approx(0.85, abs=0.08)
    assert block.Garch(student=True).fit(r[:400]).predict(2).kind == "student_t"
    assert str(block.Garch().fit(np.zeros(50)).status).startswith("fallback=1")
    v = np.exp(0.3 * np.random.default_rng(2).normal(size=300))
    for m in (block.Har(), block.Har("gaussian"), block.AutoEts(), block.AutoArima(), block.BoostedTrees(rounds=10), block.ZeroShot()):
        f = m.fit(v)
        one = f.predict(1)
        assert 0.3 < one.variance() < 4 and f.update(v).predict(1).variance() == pytest.approx(one.variance(), rel=1e-6)
        assert f.predict(3).variance() > 0
        if m.name != "zero_shot_last_value":
            with pytest.raises(ValueError):
                m.fit(np.append(v, 0.0))
    assert block.ewma_variance(np.array([1.0, 2.0]), 0.94) == pytest.approx(0.94 + 0.06 * 4)


def test_failures_become_rows(series):
    class Broken:
        name, on_variance = "broken", False

        def spec(self):
            return {}

        def fit(self, window):
            raise RuntimeError("no  fit\nat all")

    rows = backtest.block_scores(series, [Broken()], positions.Splitter(50, refit_every=30), "ret", "proxy").collect()
    assert len(rows) == 2 * 110 and all(r["missing_reason"].startswith("fit_error@") and "no fit at all" in r["missing_reason"] for r in rows)
    assert {(r["fit_origin"], r["conditioned_through"]) for r in rows} == {(-1, -1)}
    short = backtest.block_scores(series, [block.Naive()], positions.Splitter(155), "ret", "proxy", compact=False)
    assert short.count() == 2 * 5


def test_grid_resumes(spark, series, tmp_path):
    store = ResultsStore(str(tmp_path / "store"))
    g = grid.Grid(("X", "Y"), (block.Naive(), block.Ewma()), splitter=positions.Splitter(60, refit_every=21))
    first = grid.run(spark, g, series, store)
    assert {r["status"] for r in first.collect()} == {"computed"}
    n = store.read(spark).count()
    second = grid.run(spark, g, series, store)
    assert {r["status"] for r in second.collect()} == {"cached"} and store.read(spark).count() == n == 4 * 100
    h = first.first()["config_hash"]
    assert store.has(spark, h) and store.read(spark, h).count() == 100 and store.problems(store.read(spark)).isEmpty()
    assert store.read_grid(spark, first.limit(1)).count() == 100
    o = grid.outcomes(store.read(spark)).first()
    assert o["n_rows"] == 100 and o["n_fits"] == 5 and o["fallback_rate"] is None
    assert first.first()["n_rows"] == 100 and first.first()["machine"]
    with pytest.raises(ValueError):
        store.read(spark, "xyz")
    rows = store.read(spark, h)
    with pytest.raises(ValueError, match="repeated key"):
        store.write(rows.unionByName(rows), overwrite=True)
    with pytest.raises(ValueError, match="null key"):
        store.write(rows.withColumn("origin_index", F.lit(None).cast("long")), overwrite=True)


def test_grid_of_native_and_failing_models(spark, series, tmp_path):
    """Native and block models in one grid; a failing cell is told and the others run; only missing cells are computed."""

    class Broken:
        name, on_variance = "broken", False

        def spec(self):
            return {}

        def fit(self, window):
            raise RuntimeError("no fit")

    store = ResultsStore(str(tmp_path / "store"))
    small = grid.Grid(("X",), (backtest.Native("ewma"), block.Naive()), splitter=positions.Splitter(60, refit_every=21))
    grid.run(spark, small, series, store)
    whole = grid.Grid(("X", "Y"), (backtest.Native("ewma"), block.Naive(), Broken()), horizons=(1, 2), splitter=positions.Splitter(60, refit_every=21))
    told = {(r["asset"], r["model"], r["horizon"]): r for r in grid.run(spark, whole, series, store).collect()}
    assert {k for k, r in told.items() if r["status"] == "cached"} == {("X", "ewma", 1), ("X", "naive", 1)}
    assert {k[1] for k, r in told.items() if r["status"] == "failed"} == {"broken"} and len(told) == 12
    assert all(r["n_missing"] == r["n_rows"] for k, r in told.items() if k[1] == "broken")
    rows = store.read(spark).where("horizon = 1 and asset = 'X'")
    native = {r["origin_index"]: r["forecast_var"] for r in rows.where("model = 'ewma'").collect()}
    own = {r["origin_index"]: r["forecast_var"] for r in backtest.block_scores(series.where("asset = 'X'"), [block.Ewma()], positions.Splitter(60, refit_every=21), "ret", "proxy").collect()}
    assert native.keys() == own.keys() and all(native[k] == pytest.approx(v) for k, v in own.items())


def test_retransformations_by_hand():
    rng = np.random.default_rng(4)
    v = np.exp(0.4 * rng.standard_t(5, size=300))
    e = np.array([0.1, -0.3, 0.5])
    assert block.retransformation("smearing", e) == pytest.approx(np.mean(np.exp(e))) and block.retransformation("gaussian", e) == pytest.approx(math.exp((0.01 + 0.09 + 0.25) / 6))
    for make in (block.AutoEts, block.AutoArima, block.BoostedTrees):
        a, b = make().fit(v), make(retransform="gaussian").fit(v)
        assert make().spec()["retransform"] == "smearing" and a.predict(1).variance() / b.predict(1).variance() == pytest.approx(a.factor / b.factor)
        assert a.factor != b.factor


def test_garch_that_does_not_converge_falls_back(monkeypatch):
    r = garch_path(300, 3)
    monkeypatch.setattr(block, "simplex", lambda f, start, scale, steps: (start, 0.0, False))
    fitted = block.Garch().fit(r)
    assert str(fitted.status) == "fallback=1|not converged" and fitted.predict(1).variance() == pytest.approx(block.ewma_variance(r, 0.94))


def test_confidence_sets_of_two_horizons(spark):
    rng = np.random.default_rng(5)
    rows = [("X", h, i, m, float(rng.gamma(2) + 3 * (m == "c"))) for h in (1, 2) for i in range(60) for m in "abc"]
    long = spark.createDataFrame(rows, "asset string, horizon long, origin_index long, model string, loss double")
    got = inference.comparison(long, seed=1, n_boot=200).collect()
    assert {(r["horizon"], r["model"]) for r in got} == {(h, m) for h in (1, 2) for m in "abc"}
    assert all(not r["included"] and r["n_beaten"] == 0 for r in got if r["model"] == "c")
    less = {(r["model_a"], r["model_b"]): r for r in inference.diebold_mariano(long.where("horizon = 1"), alternative="less").collect()}
    assert less["a", "c"]["p_value"] < 0.01 and less["c", "a"]["p_value"] > 0.99 and less["a", "b"]["n_dropped"] == 0 and not less["a", "b"]["variance_nonpositive"]


def test_panel_files_and_reports(spark, tmp_path):
    from oriel.plans import panel

    head = "<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\n"
    for folder, name in (("daily/idx", "aaa.txt"), ("moved", "bbb.txt"), ("one", "ccc.txt"), ("two", "ccc.txt")):
        (tmp_path / "raw" / folder).mkdir(parents=True, exist_ok=True)
        ticker = name[:3].upper()
        (tmp_path / "raw" / folder / name).write_text(head + "".join(f"{ticker},D,202001{d:02d},0,{10 + d},{12 + d},{9 + d},{11 + d},5,0\n" for d in range(1, 9)))
    root = str(tmp_path / "raw")
    known = panel.Registry((panel.Series("A", "AAA", "daily/idx/aaa.txt"), panel.Series("B", "BBB", "daily/idx/bbb.txt", "etf_proxy")), (panel.Series("C", "CCC", "daily/ccc.txt"),))
    assert known.of("C").file == "ccc.txt" and panel.located(spark, known.of("B"), root).endswith("moved/bbb.txt")
    with pytest.raises(FileNotFoundError, match="2 files"):
        panel.located(spark, known.of("C"), root)
    with pytest.raises(KeyError):
        known.of("Z")
    targets, quality = panel.build_from_files(spark, known, root, start=date(2020, 1, 3))
    assert targets.count() == 12 and targets.where("ret is null").count() == 0 and quality.first()["n_bars"] == 8
    panel.write_diagnostics(targets, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert panel.report(targets, quality).count("| A |") == 2


def test_toy_benchmark(spark):
    from oriel.plans import toy

    rows = toy.run(spark, (backtest.Native("naive"), backtest.Native("ewma"), block.Har()), n_days=701, steps=200)
    best = toy.summary(rows).collect()
    assert {r["n"] for r in best} == {200} and [r["crps"] for r in best] == sorted(r["crps"] for r in best)
    assert all(0.004 < r["crps"] < 0.009 and r["qlike"] < 1 for r in best)


def test_identity():
    texts = [identity.text_of(x) for x in (1, 1.0, "1", True, None, [1], {"a": 1}, {1}, date(2020, 1, 1), {"float": 1.0}, {"map": {}}, {}, [], "")]
    assert len(set(texts)) == len(texts)
    assert identity.text_of({"b": (1, np.int64(2)), "a": -0.0}) == identity.text_of({"a": 0.0, "b": [1, 2]})
    assert identity.text_of(float("nan")) == identity.text_of(np.float64("nan")) and identity.text_of(0.1) != identity.text_of(0.1 + 1e-17 * 8)
    assert identity.config_hash({"a": 1, "b": 2}) == identity.config_hash({"b": 2, "a": 1}) != identity.config_hash({"a": 1.0, "b": 2})
    for bad in (b"x", {1: 2}, object()):
        with pytest.raises(TypeError):
            identity.text_of(bad)
    one = identity.experiment(block.Naive(), {}, positions.Splitter(50), 0, "daily", environment={})
    assert one == identity.experiment(block.Naive(), {}, positions.Splitter(50), 0, "none", environment={})  # cannot matter without blocks
    two = positions.Splitter(50, refit_every=5)
    assert identity.experiment(block.Naive(), {}, two, 0, "daily", environment={}) != identity.experiment(block.Naive(), {}, two, 0, "none", environment={})
    assert json.dumps(one)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-03,1,2,0.5,1.5,10\n2024-01-02,1,2,0.5,1.2,9\n")
    (tmp_path / "b.txt").write_text("<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\nFAKE.US,D,20050105,000000,1,2,0.5,1.5,7,0\n")
    got = files.daily_csv(spark, str(tmp_path / "a.csv"), "A").collect()
    assert [r["close"] for r in got] == [1.2, 1.5] and got[0]["asset"] == "A"
    bulk = files.daily_csv(spark, str(tmp_path / "b.txt")).first()
    assert bulk["asset"] == "FAKE.US" and bulk["ts"] == datetime(2005, 1, 5) and bulk["volume"] == 7.0
    done = files.ingest(spark, str(tmp_path / "b.txt"), str(tmp_path / "cache"), "fake", expect_ticker="fake.us")
    assert done["rows"] == 1 and len(done["raw_sha256"]) == 64 and files.cached(spark, str(tmp_path / "cache"), "fake").count() == 1
    with pytest.raises(files.BarFileError):
        files.ingest(spark, str(tmp_path / "b.txt"), str(tmp_path / "cache"), "x", expect_ticker="OTHER")
    (tmp_path / "c.csv").write_text("Timestamp,CLOSE\n2024-01-02 09:00:00,5\n")
    assert files.own_csv(spark, str(tmp_path / "c.csv"), "C", zone="America/New_York").first()["ts"] == datetime(2024, 1, 2, 14)
    line = "{t},1,2,0.5,1.5,3,0,0,1,0,0,0\n"
    with zipfile.ZipFile(tmp_path / "k.zip", "w") as z:
        z.writestr("k.csv", line.format(t=1704067200000) + line.format(t=1704067200000) + line.format(t=1704067260000000))
    m = files.minute_zip(spark, str(tmp_path / "k.zip"), "BTC-USD").orderBy("ts").collect()
    assert [r["ts"] for r in m] == [datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 1)]
    assert [files.payload_kind(x) for x in (b"", b"<html>", b"Exceeded the daily hits limit", b"a,b\n")] == ["empty", "html", "limit", "csv"]


def test_synthetic_and_regime_order(spark):
    a = synthetic.simulated(30)
    assert a.equals(synthetic.simulated(30)) and (a.high >= a[["open", "close"]].max(axis=1)).all() and (a.true_variance > 0).all()
    assert synthetic.simulated_bars(spark, n_days=5).count() == 5


def test_partitioning_changes_nothing(series):
    s = positions.Splitter(40, horizon=2)
    one = backtest.native_scores(series, s, "ret", "proxy").select("asset", "model", "origin_index", "horizon", F.round("crps", 12))
    two = backtest.native_scores(series.repartition(7), s, "ret", "proxy").select(one.columns[:4] + [F.round("crps", 12)])
    assert one.exceptAll(two).isEmpty() and one.count() == two.count()


def test_streaming_bars(spark, tmp_path):
    from oriel.streaming import bars as live

    rows = spark.createDataFrame([("A", datetime(2024, 1, 1, 0, m), float(m)) for m in (0, 1, 4, 6, 30)], "asset string, ts timestamp, price double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.bars(stream).writeStream.format("memory").queryName("bars_live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("bars_live").orderBy("ts").collect()
    assert [(r["open"], r["close"], r["n"]) for r in got] == [(0.0, 4.0, 3), (6.0, 6.0, 1), (30.0, 30.0, 1)]


def test_confidence_sets_draw_ten_thousand_resamples():
    from inspect import signature

    from oriel.operators import inference

    assert {signature(f).parameters["n_boot"].default for f in (inference.confidence_set, inference.model_confidence_sets, inference.comparison)} == {10_000}


def test_block_models_forecast_every_origin(monkeypatch):
    from oriel import queries

    seen = []

    def stop(rows, models, split, *a, **b):
        seen.append(split)
        raise InterruptedError

    monkeypatch.setattr(queries, "series", lambda *a: None)
    monkeypatch.setattr(queries.backtest, "block_scores", stop)
    names = ["model_garch", "model_garch_t", "model_gjr", "model_har", "model_autoets", "model_autoarima", "model_gbm", "model_zero_shot"]
    for name in names:
        with pytest.raises(InterruptedError):
            queries.QUERIES[name](None, "")
    assert [x.step for x in seen] == [1] * len(names)
