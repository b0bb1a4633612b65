"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
``run`` writes every stage's result in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm import knn_quality, line_dedup, ngram_join, packing, substring_dedup
from oriel.llm.base import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(rows: DataFrame, text: str) -> DataFrame:
    """The columns of documents with a new text; rows that lost their last word go."""
    rows = rows.where((F.col("n_removed") == 0) | F.col(text).rlike("[^\\x20\\x09-\\x0D]"))
    changed = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col(text))
    return rows.select("doc_id", changed.alias("text"), "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for quality 1."""
    fit = knn_quality.Fit()
    model = knn_quality.fitted(docs, table(spark, sf_dir, "labels"), fit)
    return knn_quality.scored(docs.select(COLUMNS), model).where(F.col("quality_score") >= fit.threshold).select(COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks that an earlier one holds."""
    return _with_text(line_dedup.without_shared_lines(docs.select(COLUMNS)), "kept_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document of smallest identifier."""
    from pyspark.sql import Window

    rows = docs.select(COLUMNS).withColumn("i", F.coalesce("doc_id", F.lit(-(2**63))))
    groups = ngram_join.linked(rows, key="i")
    stay = groups.where("i = component_id").select("i").distinct().hint("merge")
    once = Window.partitionBy("i", F.xxhash64("text")).orderBy("i")
    return rows.join(stay, "i", "left_semi").withColumn("nth", F.row_number().over(once)).where("nth = 1").select(COLUMNS)


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 35-word windows that stand elsewhere too."""
    return _with_text(substring_dedup.without_repeats(docs.select(COLUMNS)), "kept_text")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents and their places in sequences of 1024 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_deduplication),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenisation, alignment and components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
