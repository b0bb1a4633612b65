"""Panels: which series there are, where their raw files lie, and their targets in one call."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars, diagnostics
from ..sources import files


@dataclass(frozen=True)
class Series:
    """A series of a panel: its raw file by path below a root, what it is, and the target it is scored on."""

    asset: str
    ticker: str
    path: str
    role: str = "index"
    target: str = "overnight_plus_range"

    @property
    def file(self) -> str:
        return self.path.rsplit("/", 1)[-1]


class Registry:
    """Series by asset: those of the panel, and retired ones that can still be read."""

    def __init__(self, panel: tuple[Series, ...], retired: tuple[Series, ...] = ()):
        self.panel, self.retired = {s.asset: s for s in panel}, {s.asset: s for s in retired}
        if len(self.panel) + len(self.retired) != len(panel) + len(retired) or set(self.panel) & set(self.retired):
            raise ValueError("a registry names each asset once")

    def of(self, asset: str) -> Series:
        known = self.panel | self.retired
        if asset not in known:
            raise KeyError(f"{asset} is neither in the panel ({', '.join(sorted(self.panel))}) nor retired ({', '.join(sorted(self.retired))})")
        return known[asset]


def located(spark: SparkSession, series: Series, root: str) -> str:
    """The path of a series' raw file: as registered, else the only file of its name below ``root``.

    Looked up by Spark's file source, so the root may be in any store Spark reads.
    """
    names = lambda pattern: [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path").collect()]  # noqa: E731  files of one name
    found = sorted(names(series.file))
    exact = [p for p in found if p.endswith("/" + series.path)]
    if exact:
        return exact[0]
    if len(found) != 1:
        raise FileNotFoundError(f"{series.asset}: {len(found)} files named {series.file} below {root}")
    return found[0]


def build(raw: DataFrame, start: date | None = None, end: date | None = None) -> tuple[DataFrame, DataFrame]:
    """(targets, quality) of raw bars (asset, ts, open, high, low, close): repaired, measured, then trimmed.

    Trimming comes last, so that the first day of the span keeps its previous close.
    """
    fixed = bars.repaired(raw)
    targets = bars.targets(fixed)
    if start is not None or end is not None:
        targets = bars.trimmed(targets, start or date.min, end or date.max)
    return targets, bars.quality(fixed)


def build_from_files(spark: SparkSession, registry: Registry, root: str, start: date | None = None, end: date | None = None) -> tuple[DataFrame, DataFrame]:
    """The same for all series of a registry's panel, read from their raw files."""
    raw = None
    for s in registry.panel.values():
        one = files.daily_csv(spark, located(spark, s, root), s.asset)
        raw = one if raw is None else raw.unionByName(one)
    return build(raw, start, end)


def write_diagnostics(targets: DataFrame, path: str) -> None:
    """Diagnostics of every asset as one CSV file with a header: a row an asset."""
    diagnostics.diagnose(targets).orderBy("asset").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report(targets: DataFrame, quality: DataFrame) -> str:
    """Markdown tables of a panel: spans and targets, bar quality.  A row an asset, so the driver writes them."""
    spans = diagnostics.diagnose(targets).select("asset", "first_day", "last_day", "n_days", "max_gap", "n_invalid_targets", F.round("annual_vol", 4).alias("annual_vol"), F.round("overnight_share", 4).alias("overnight_share"))
    return "\n\n".join(f"## {title}\n\n{markdown(t.orderBy('asset'))}" for title, t in (("Series", spans), ("Bars", quality)))


def markdown(table: DataFrame) -> str:
    """A small table as Markdown; undefined values are empty."""
    rows = [table.columns, ["---"] * len(table.columns), *[["" if x is None else str(x) for x in r] for r in table.collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
