"""Synthetic OHLC paths with a known variance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def simulated(n_days: int = 701, seed: int = 20260823, price: float = 4000.0, steps: int = 5000, overnight: float = 0.09, omega: float = 2.4e-6, alpha: float = 0.06, beta: float = 0.92) -> pd.DataFrame:
    """Daily bars of a GARCH(1,1) variance: an overnight jump, then a random walk whose extremes are the bar's."""
    rng = np.random.default_rng(seed)
    v, last, rows = omega / (1 - alpha - beta), np.log(price), []
    for day in pd.bdate_range("2019-01-02", periods=n_days):
        start = last + rng.normal(0, np.sqrt(v * overnight))
        walk = start + np.concatenate(([0.0], np.cumsum(rng.normal(0, np.sqrt(v * (1 - overnight) / steps), steps))))
        rows.append((day, *np.round(np.exp([walk[0], walk.max(), walk.min(), walk[-1]]), 4), v))
        v, last = omega + alpha * (walk[-1] - last) ** 2 + beta * v, walk[-1]
    return pd.DataFrame(rows, columns=["ts", "open", "high", "low", "close", "true_variance"])


def simulated_bars(spark: SparkSession, asset: str = "TOY", **settings) -> DataFrame:
    pdf = simulated(**settings)
    pdf.insert(0, "asset", asset)
    return spark.createDataFrame(pdf)
