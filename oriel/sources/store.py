"""Results store: scored rows in Parquet, one partition for each configuration hash; what is there is never written again."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["config_hash", "asset", "origin_index", "horizon"]


class ResultsStore:
    def __init__(self, root: str):
        self.root = root

    def read(self, spark: SparkSession, config_hash: str | None = None) -> DataFrame:
        """All rows, or those of one hash (partition pruning reads that folder only)."""
        rows = spark.read.parquet(self.root).withColumn("config_hash", F.col("config_hash").cast("string"))
        if config_hash is None:
            return rows
        if not re.fullmatch("[0-9a-f]{64}", config_hash):
            raise ValueError("a hash has 64 hexadecimal digits")
        return rows.where(F.col("config_hash") == config_hash)

    def hashes(self, spark: SparkSession) -> list[str]:
        try:
            return sorted(r[0] for r in self.read(spark).select("config_hash").distinct().collect())  # one a cell
        except AnalysisException:
            return []

    def has(self, spark: SparkSession, config_hash: str) -> bool:
        return config_hash in self.hashes(spark)

    def read_grid(self, spark: SparkSession, manifest: DataFrame) -> DataFrame:
        return self.read(spark).join(manifest.select("config_hash").distinct(), "config_hash", "left_semi")

    def problems(self, rows: DataFrame) -> DataFrame:
        """Keys that are null or repeated."""
        null = rows.where(" or ".join(f"{k} is null" for k in KEYS)).groupBy(*KEYS).agg(F.lit("null key").alias("problem"))
        return null.unionByName(rows.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1").drop("n").withColumn("problem", F.lit("repeated key")))

    def missing(self, cells: DataFrame) -> DataFrame:
        """Rows of ``cells`` whose config_hash the store does not hold."""
        try:
            have = self.read(cells.sparkSession).select("config_hash").distinct()
        except AnalysisException:  # nothing written yet
            return cells
        return cells.join(have, "config_hash", "left_anti")

    def write(self, rows: DataFrame, overwrite: bool = False) -> None:
        """Appends the partitions the store lacks; with ``overwrite`` replaces those the rows bring.

        Rows are written in order of their keys.  Null and repeated keys are
        refused before anything is written.
        """
        if not overwrite:
            rows = self.missing(rows)
        bad = self.problems(rows).first()
        if bad is not None:
            raise ValueError(f"{bad['problem']}: {[bad[k] for k in KEYS]}")
        rows = rows.repartition("config_hash").sortWithinPartitions(*KEYS)
        out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") if overwrite else rows.write.mode("append")
        out.partitionBy("config_hash").parquet(self.root)
