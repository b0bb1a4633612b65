"""Positions, rolling origins, refit blocks, and windows over valid targets only.

Everything is a window by asset: one shuffle on the asset, no loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_time() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("ts")


def by_pos() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("pos")



@dataclass(frozen=True)
class Splitter:
    """Rolling origins: ``window`` observations to fit on, ``horizon`` ahead, every ``step``, refitted every ``refit_every`` origins."""

    window: int
    horizon: int = 1
    step: int = 1
    refit_every: int = 1

    def __post_init__(self):
        if self.window < 2 or min(self.horizon, self.step, self.refit_every) < 1:
            raise ValueError("window must be 2 or more, the others 1 or more")

    def n_splits(self, n: int) -> int:
        return max(0, (n - self.horizon - self.window) // self.step + 1)


def positioned(rows: DataFrame) -> DataFrame:
    """Adds pos (0 upwards by time) and n (rows of the asset)."""
    return rows.withColumns({"pos": F.row_number().over(by_time()).cast("long") - 1, "n": F.count("*").over(Window.partitionBy("asset"))})


def origins(rows: DataFrame, s: Splitter) -> DataFrame:
    """Keeps the origin rows and adds k, refit, block_id and fit_origin.

    A refit happens every ``refit_every`` origins, not days.
    """
    k = F.floor((F.col("pos") - (s.window - 1)) / s.step).cast("long")
    keep = (F.col("pos") >= s.window - 1) & (F.col("pos") <= F.col("n") - 1 - s.horizon) & ((F.col("pos") - (s.window - 1)) % s.step == 0)
    out = rows.where(keep).withColumn("k", k)
    block = F.floor(F.col("k") / s.refit_every).cast("long")
    return out.withColumns({"refit": F.col("k") % s.refit_every == 0, "block_id": block, "fit_origin": block * (s.refit_every * s.step) + (s.window - 1)})


def n_splits(rows: DataFrame, s: Splitter) -> DataFrame:
    n = F.greatest(F.floor((F.col("n") - s.horizon - s.window) / s.step) + 1, F.lit(0)).cast("long")
    return rows.groupBy("asset").agg(F.count("*").alias("n")).select("asset", n.alias("n_splits"))


def train_windows(rows: DataFrame, column: str, window: int) -> DataFrame:
    """The values of the last ``window`` rows as an array, on every row that has so many."""
    frame = by_pos().rowsBetween(-(window - 1), 0)
    return rows.where(F.col("pos").isNotNull()).withColumn("train", F.when(F.col("pos") >= window - 1, F.collect_list(column).over(frame)))


def supervised(rows: DataFrame, column: str, lookback: int, horizon: int) -> DataFrame:
    """(asset, pos, inputs, targets): every full pair of ``lookback`` values up to a position and the ``horizon`` after it.

    The last target is the asset's last value; pairs never reach beyond what is there.
    """
    past, future = by_pos().rowsBetween(-(lookback - 1), 0), by_pos().rowsBetween(1, horizon)
    out = rows.select("asset", "pos", F.collect_list(column).over(past).alias("inputs"), F.collect_list(column).over(future).alias("targets"))
    return out.where((F.size("inputs") == lookback) & (F.size("targets") == horizon))


def compaction(rows: DataFrame, valid: str, window: int) -> DataFrame:
    """For every row the last ``window`` valid positions up to it: first and last of them, and how many are skipped between.

    A frame over the valid rows alone, the last valid position carried forward,
    and an equi-join: an as-of join without a range join.  ``failure`` tells
    where the history is too short.
    """
    good = rows.where(F.col(valid)).select("asset", "pos", F.row_number().over(by_pos()).cast("long").alias("rank"))
    frame = by_pos().rowsBetween(-(window - 1), 0)
    ends = good.select("asset", F.col("pos").alias("last_pos"), F.min("pos").over(frame).alias("first_pos"), F.count("*").over(frame).alias("have"))
    upto = by_pos().rowsBetween(Window.unboundedPreceding, 0)
    asof = rows.select("asset", "pos", F.last(F.when(F.col(valid), F.col("pos")), ignorenulls=True).over(upto).alias("last_pos"), F.count_if(F.col(valid)).over(upto).alias("n_valid"))
    out = asof.join(ends, ["asset", "last_pos"], "left")
    full = F.coalesce(F.col("have") == window, F.lit(False))
    return out.select(
        "asset", "pos", "n_valid",
        F.when(full, F.col("first_pos")).alias("first_pos"),
        F.when(full, F.col("last_pos")).alias("last_pos"),
        F.when(full, F.col("last_pos") - F.col("first_pos") + 1 - window).alias("n_dropped"),
        F.when(~full, F.lit("insufficient_history")).otherwise(F.lit("")).alias("failure"),
    )


def dropped_positions(windows: DataFrame, rows: DataFrame, valid: str) -> DataFrame:
    """(asset, pos, dropped): each invalid position between the first and the last of a compacted window."""
    bad = rows.where(~F.col(valid)).select("asset", F.col("pos").alias("dropped"))
    spans = windows.where("n_dropped > 0").select("asset", "pos", F.explode(F.sequence("first_pos", "last_pos")).alias("dropped"))
    return spans.join(bad, ["asset", "dropped"], "left_semi").select("asset", "pos", "dropped")


def exploded(origin_rows: DataFrame, horizon: int) -> DataFrame:
    """A row for every origin and step ahead."""
    return origin_rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon")).withColumn("target_index", F.col("pos") + F.col("horizon"))


def misaligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each asset the first time that only one of two tables has; no row where calendars agree."""
    both = left.select("asset", "ts", F.lit(1).alias("l")).join(right.select("asset", "ts", F.lit(1).alias("r")), ["asset", "ts"], "full_outer")
    return both.where("l is null or r is null").groupBy("asset").agg(F.min("ts").alias("first_mismatch"), F.count("*").alias("n_mismatches"))


def calendar_gaps(rows: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` longest gaps between neighbouring days of each asset; the earliest first among equals."""
    gap = rows.select("asset", F.lag("ts").over(by_time()).alias("after"), F.col("ts").alias("before"), F.datediff("ts", F.lag("ts").over(by_time())).cast("long").alias("gap_days")).where("gap_days is not null")
    w = Window.partitionBy("asset").orderBy(F.desc("gap_days"), "before")
    return gap.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
