"""Grids of cells (asset x model x horizon x arm): expansion, resumable runs, manifests."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import Splitter
from ..sources.store import ResultsStore
from . import identity
from .backtest import Arm, run_backtest

CELL = "cell long, asset string, model string, horizon int, arm string, config_hash string"


@dataclass(frozen=True)
class Grid:
    assets: tuple[str, ...]
    models: tuple = ()
    horizons: tuple[int, ...] = (1,)
    arms: tuple[Arm, ...] = (Arm(),)
    splitter: Splitter = field(default_factory=lambda: Splitter(100, refit_every=21))
    seed: int = 0

    def __post_init__(self):
        for part in (self.assets, [m.name for m in self.models], self.horizons, self.arms):
            if len(set(part)) != len(list(part)):
                raise ValueError("a grid's parts must differ")


def cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """One row for each cell in grid order, with its index: a product of four lists the caller gave."""
    rows = [(a, m.name, h, arm.recondition) for a in grid.assets for m in grid.models for h in grid.horizons for arm in grid.arms]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(sorted(rows))], "cell long, asset string, model string, horizon int, arm string")


def named(spark: SparkSession, grid: Grid, series: DataFrame, ret: str) -> DataFrame:
    """The cells with their hashes, which cover data digest, model, splitter, protocol and seed."""
    digest = {r["asset"]: r["digest"] for r in identity.digests(series.where(F.col("asset").isin(*grid.assets)), ret).collect()}  # one row an asset of the grid
    models, out = {m.name: m for m in grid.models}, []
    for c in cells(spark, grid).collect():  # as many rows as the caller's lists have cells
        split = replace(grid.splitter, horizon=c["horizon"])
        spec = identity.experiment(models[c["model"]], {"asset": c["asset"], "digest": digest.get(c["asset"], "")}, split, grid.seed, c["arm"])
        out.append((*c, identity.config_hash(spec)))
    return spark.createDataFrame(out, CELL)


def run(spark: SparkSession, grid: Grid, series: DataFrame, store: ResultsStore, ret: str = "ret", proxy: str = "proxy", variance: str | None = None, overwrite: bool = False) -> DataFrame:
    """Computes the cells the store lacks and returns the manifest.

    One job for each (horizon, arm) with missing cells, over those cells alone: a
    second run writes nothing.  A cell that fails as a whole does not stop the
    others: its rows carry the reason, the manifest says ``failed``.  With
    ``overwrite`` every cell is computed anew.
    """
    every = named(spark, grid, series, ret)
    todo = (every if overwrite else store.missing(every)).collect()  # at most the grid's cells
    for h in grid.horizons:
        for arm in grid.arms:
            mine = [r for r in todo if (r["horizon"], r["arm"]) == (h, arm.recondition)]
            if mine:
                only = spark.createDataFrame([(r["asset"], r["model"], r["config_hash"]) for r in mine], "asset string, model string, config_hash string")
                chosen = [m for m in grid.models if m.name in {r["model"] for r in mine}]
                rows = run_backtest(series, chosen, replace(grid.splitter, horizon=h), ret, proxy, variance, arm, grid.seed, only=only.select("asset", "model"))
                store.write(rows.join(F.broadcast(only), ["asset", "model"]), overwrite)  # as many rows as cells
    return manifest(every, {r["config_hash"] for r in todo}, store)


def manifest(every: DataFrame, computed: set[str], store: ResultsStore) -> DataFrame:
    """One row a cell: hash, status (computed, cached, failed, empty), rows, missing ones, fits, fallbacks, machine."""
    spark = every.sparkSession
    made = outcomes(store.read_grid(spark, every), ["config_hash"])
    told = every.join(made, "config_hash", "left").fillna(0, ["n_rows", "n_missing", "n_fits", "n_reported", "n_nonconverged", "n_fallback"])
    new = F.col("config_hash").isin(*computed) if computed else F.lit(False)
    status = F.when(F.col("n_rows") == 0, "empty").when((F.col("n_fits") == 0) & new, "failed").when(new, "computed").otherwise("cached")
    return told.withColumn("status", status).withColumn("machine", F.lit(identity.text_of(identity.report())))


def outcomes(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of each cell: rows, unscorable rows, and fits by status, a fit counting once however many rows it made."""
    by = by or ["asset", "model"]
    n = rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(F.col("missing_reason") != "").alias("n_missing"))
    fits = rows.where("fit_origin >= 0").groupBy(*by, "fit_origin").agg(F.min_by("fit_status", "origin_index").alias("s"))
    fits = fits.groupBy(*by).agg(F.count("*").alias("n_fits"), F.count_if(F.col("s") != "").alias("n_reported"), F.count_if(F.col("s").startswith("nonconverged")).alias("n_nonconverged"), F.count_if(F.col("s").startswith("fallback")).alias("n_fallback"))
    return n.join(fits, by, "left").withColumn("fallback_rate", F.try_divide(F.col("n_fallback").cast("double"), F.when(F.col("n_reported") > 0, F.col("n_reported"))))


def rollup(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("n_cells"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON file: a row a cell, so the driver writes it."""
    manifest.coalesce(1).write.mode("overwrite").json(path)


def missing(all_cells: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return all_cells.join(done, keys, "left_anti")


def indexed(assets: DataFrame, models: list[str], horizons: list[int], arms: list[str]) -> DataFrame:
    """Cells of the assets of a table with literal lists, numbered in grid order.

    Assets are gathered into one array (as many as the grid has), the rest is
    literal: no product of tables, no window over all rows.
    """
    rest = [F.struct(F.lit(m).alias("model"), F.lit(h).cast("long").alias("horizon"), F.lit(a).alias("arm")) for m in sorted(models) for h in sorted(horizons) for a in sorted(arms)]
    ordered = assets.agg(F.sort_array(F.collect_set("asset")).alias("a")).select(F.posexplode("a").alias("k", "asset"))
    return ordered.select("k", "asset", F.posexplode(F.array(*rest)).alias("j", "c")).select("asset", "c.*", (F.col("k") * len(rest) + F.col("j")).cast("long").alias("cell"))
