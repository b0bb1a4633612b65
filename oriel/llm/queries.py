"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html, knn_quality, line_dedup, ngram_join, packing, quality_rules, substring_dedup, token_counts
from .base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"), shingle=4, percent=85)


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.verdict(quality_rules.stored(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


@query
def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy 2 rejects, and what it alone rejects, by op4's ledger."""
    return quality_rules.ablation(quality_rules.stored(table(spark, sf_dir, "documents")))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.without_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


_LEDGER = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS tri FROM d
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c
      FROM (SELECT doc_id, unnest(tri) AS x, unnest(range(1, len(tri) + 1)) AS i FROM g))
    WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT g.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaimed, len(list_filter(w, lambda x: NOT regexp_matches(x, '\pL')))::BIGINT AS n_letterless
  FROM g LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (5 * n_symbols > n_words)::BIGINT
    + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))::BIGINT
    + 32 * (5 * n_exclaimed > n_words)::BIGINT + 64 * (5 * n_letterless > n_words)::BIGINT AS failures FROM m
)
"""
ORACLE_SQL["op4_quality_rules"] = _LEDGER + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed,
       failures = 0 AS kept, failures::BIGINT AS failures FROM f
"""
ORACLE_SQL["quality_rule_ablation"] = _LEDGER + f"""
, rules(rule, bit) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in quality_rules.RULES.items())})
SELECT rule, count(*) FILTER (failures & bit <> 0) AS n_failed, count(*) FILTER (failures = bit) AS n_only FROM rules LEFT JOIN f ON true GROUP BY rule
"""

ORACLE_SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM d
), x AS (SELECT doc_id, len(g) AS n, hash(unnest(g)) AS h FROM s
), rare AS (SELECT h, count(*) AS c FROM x GROUP BY 1 HAVING count(*) > 1
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) JOIN rare ON rare.h = a.h
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach(doc_id, other) AS (SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.m, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1) c ON c.doc_id = s.doc_id
"""

ORACLE_SQL["op8_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), x AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS spot, md5(unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i : i + 34], ' ')))) AS h FROM d WHERE len(w) >= 35
), again AS (SELECT doc_id, spot FROM (SELECT doc_id, spot, count(*) OVER (PARTITION BY h) AS c FROM x) WHERE c > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(spot, spot + 35)) AS p FROM again
), words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL["op6_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""
