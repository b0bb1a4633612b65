"""Streaming bars and recursive variance.

Extensions: tumbling bars with a watermark, and an exponentially weighted
variance for each asset kept as state between batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def bars(ticks: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """OHLC of each asset and window of a stream (asset, ts, price); ticks later than ``late`` are left out."""
    return ticks.withWatermark("ts", late).groupBy("asset", F.window("ts", width)).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").alias("n")).select("asset", F.col("window.start").alias("ts"), "open", "high", "low", "close", "n")


def running_variance(returns: DataFrame, decay: float = 0.94) -> DataFrame:
    """(asset, n, variance) after each batch of a stream (asset, ts, ret); the state is two numbers an asset."""

    def step(key, parts, state):
        n, v = state.get if state.exists else (0, 0.0)
        for r in pd.concat(list(parts)).sort_values("ts").ret:
            v = r * r if n == 0 else decay * v + (1 - decay) * r * r
            n += 1
        state.update((n, v))
        yield pd.DataFrame({"asset": [key[0]], "n": [n], "variance": [v]})

    return returns.groupBy("asset").applyInPandasWithState(step, "asset string, n long, variance double", "n long, v double", "update", GroupStateTimeout.NoTimeout)
