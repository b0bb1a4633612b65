"""Dated crisis regimes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALM = "calm"


@dataclass(frozen=True)
class Regime:
    tag: str
    start: date
    end: date  # included

    def __post_init__(self):
        if self.end < self.start:
            raise ValueError(f"{self.tag} ends before it starts")


def checked(regimes: tuple[Regime, ...]) -> tuple[Regime, ...]:
    """In order of time; regimes may not overlap or share a tag."""
    ordered = tuple(sorted(regimes, key=lambda r: r.start))
    for a, b in zip(ordered, ordered[1:], strict=False):
        if b.start <= a.end:
            raise ValueError(f"{a.tag} and {b.tag} overlap")
    if len({r.tag for r in ordered} | {CALM}) != len(ordered) + 1:
        raise ValueError("tags must differ from each other and from calm")
    return ordered


# Market crises by closed date intervals.
CRISES = checked((
    Regime("gfc", date(2008, 9, 1), date(2009, 3, 31)),
    Regime("covid", date(2020, 2, 1), date(2020, 4, 30)),
    Regime("tightening_2022", date(2022, 1, 1), date(2022, 10, 31)),
    Regime("spike_2024_08", date(2024, 8, 1), date(2024, 8, 31)),
))
#: Known but not dated yet; looking them up tells so.
PENDING = {"stress_2025_26": "its dates are not fixed yet"}


def regime_by_tag(tag: str, regimes: tuple[Regime, ...] = CRISES) -> Regime:
    for r in regimes:
        if r.tag == tag:
            return r
    raise KeyError(f"{tag}: {PENDING.get(tag, 'unknown regime')}")


def tag_of(day: Column, regimes: tuple[Regime, ...] = CRISES) -> Column:
    out = F
    for r in checked(regimes):
        out = out.when(day.between(F.lit(r.start), F.lit(r.end)), F.lit(r.tag))
    return F.lit(CALM) if out is F else out.otherwise(F.lit(CALM))


def order_of(tag: Column, regimes: tuple[Regime, ...] = CRISES) -> Column:
    """0 for calm, then by time."""
    out = F.when(tag == CALM, 0)
    for k, r in enumerate(checked(regimes), 1):
        out = out.when(tag == r.tag, k)
    return out


def indicators(rows: DataFrame, day: str, regimes: tuple[Regime, ...] = CRISES) -> DataFrame:
    """One 0/1 column for each regime."""
    return rows.withColumns({f"is_{r.tag}": F.coalesce(F.col(day).between(F.lit(r.start), F.lit(r.end)), F.lit(False)).cast("long") for r in checked(regimes)})


def coverage(scored_days: DataFrame, all_days: DataFrame, regimes: tuple[Regime, ...] = CRISES) -> DataFrame:
    """For each asset and regime: days that are forecast targets, and days there are.  Both: (asset, day)."""
    have = all_days.withColumn("regime", tag_of(F.col("day"), regimes)).groupBy("asset", "regime").agg(F.count("*").alias("available"))
    got = scored_days.distinct().withColumn("regime", tag_of(F.col("day"), regimes)).groupBy("asset", "regime").agg(F.count("*").alias("scored"))
    return have.join(got, ["asset", "regime"], "left").select("asset", "regime", "available", F.coalesce("scored", F.lit(0)).cast("long").alias("scored"))
