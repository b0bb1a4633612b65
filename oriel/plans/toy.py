"""The benchmark on a synthetic series whose variance is known: all models, every origin, one table of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import block
from ..operators import bars, positions, scoring
from ..sources import synthetic
from . import backtest

#: Observations fitted on, and origins scored.
WINDOW, ORIGINS = 500, 200
MODELS = (backtest.Native("naive"), backtest.Native("ewma"), block.Garch(), block.Garch(student=True), block.Har(), block.AutoEts(), block.AutoArima(), block.BoostedTrees())


def toy_series(spark: SparkSession, **settings) -> DataFrame:
    """(asset, ts, pos, n, ret, proxy, rv) of the synthetic bars; models of variances read the target, one that is above 0."""
    t = bars.targets(bars.repaired(synthetic.simulated_bars(spark, **settings))).where("ret is not null")
    return positions.positioned(t.select("asset", "ts", "ret", F.col("overnight_plus_range").alias("proxy"), F.col("overnight_plus_range").alias("rv")))


def run(spark: SparkSession, models=MODELS, refit_every: int = 1, recondition: str = "daily", **settings) -> DataFrame:
    """Scored rows of all models."""
    split = positions.Splitter(WINDOW, horizon=1, step=1, refit_every=refit_every)
    return backtest.run_backtest(toy_series(spark, **settings), models, split, "ret", "proxy", "rv", backtest.Arm(recondition))


def grid_series(spark: SparkSession, assets: int = 4, **settings) -> DataFrame:
    """Series like the toy one for several assets, each with a seed of its own."""
    out = None
    for k in range(assets):
        one = toy_series(spark, asset=f"TOY{k}", seed=20260823 + k, **settings)
        out = one if out is None else out.unionByName(one)
    return out


def summary(rows: DataFrame) -> DataFrame:
    return scoring.summary(rows).orderBy("crps")
