"""Rule ledger: every rule is evaluated once per document, its failure kept as a bit beside the measurements.

``stored`` writes bits and measurements once; ``verdict`` applies a versioned
policy (a mask of bits) to the stored ledger without touching the texts again;
``ablation`` counts, by bitwise aggregation over the ledger alone, what each rule
removes.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACE, text_or_empty, written

#: Bit, name and meaning of each rule; a bit once given keeps its meaning.
RULES = {
    "few_words": 1 << 0,  # fewer than 50 words
    "repeats": 1 << 1,  # more than half of the words lie in repeated 3-word windows
    "symbols": 1 << 2,  # more than one symbol for each 5 words
    "dup_lines": 1 << 3,  # more than half of the lines with a word repeat an earlier one
    "word_length": 1 << 4,  # mean word length outside 2 to 15 code points
    "exclaimed": 1 << 5,  # more than one exclamation mark for each 5 words
    "letterless": 1 << 6,  # more than a fifth of the words have no letter
}
#: Policies by version: the rules that reject.
POLICIES = {1: ("few_words", "repeats"), 2: tuple(RULES)}


def mask_of(version: int) -> int:
    return sum(RULES[r] for r in POLICIES[version])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words within 3-word windows that stand in the text twice or more: windows are sorted by hash, equal neighbours marked."""

    def of(h: Column) -> Column:
        windows = F.array_sort(F.transform(F.slice(h, 1, F.size(h) - 2), lambda _, i: F.struct(F.xxhash64(h[i], h[i + 1], h[i + 2]).alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            last = F.size(s) - 1
            twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(h) >= 3, let(windows, marked)).otherwise(0)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of).cast("long")


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, the measurements and ``failures``, the bit mask of failed rules.

    Null texts count as empty: no words, all counts 0, rule ``few_words`` fails.
    Whole texts of any length are measured.  Repeated rows and null keys keep a
    row each; other columns are left out, whatever their names; an empty table
    gives no rows.  3-word windows are compared by a 64-bit hash within a text.
    """
    t = F.col("t")
    out = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    out = out.select("k", "t", F.filter(F.split(t, SPACE), lambda w: w != "").alias("w"), F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "").alias("l"))
    w, lines = F.col("w"), F.col("l")
    without = lambda signs: F.length(t) - F.length(F.translate(t, signs, ""))
    out = out.select(
        F.col("k").alias(key),
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        without("!").cast("long").alias("n_exclaimed"),
        F.regexp_count(F.concat(F.lit(" "), t), F.lit("[\\x20\\x09-\\x0D][^\\p{L}\\x20\\x09-\\x0D]++(?=[\\x20\\x09-\\x0D]|\\z)")).cast("long").alias("n_letterless"),
    )
    n = F.col("n_words")
    fails = {
        "few_words": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 5 * F.col("n_symbols") > n,
        "dup_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "word_length": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        "exclaimed": 5 * F.col("n_exclaimed") > n,
        "letterless": 5 * F.col("n_letterless") > n,
    }
    bits = F.lit(0)
    for rule, failed in fails.items():
        bits = bits.bitwiseOR(F.when(failed, RULES[rule]).otherwise(0))
    return out.withColumn("failures", bits.cast("long"))


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger as a written table: texts are read and measured once, whatever is asked of it later."""
    return written(ledger(docs, key, text), "rule-ledger")


def verdict(rows: DataFrame, version: int = 2) -> DataFrame:
    """Adds base_failed (policy 1) and kept (false if base_failed, else the policy of ``version``) to a ledger."""
    failed = F.col("failures").bitwiseAND(F.lit(mask_of(1))) != 0
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("failures").bitwiseAND(F.lit(mask_of(version))) == 0))


def ablation(rows: DataFrame, version: int = 2) -> DataFrame:
    """For each rule of a policy: documents failing it, and those only it removes (kept once the rule is left out).

    One aggregation by distinct bit mask, at most 2**rules groups, then rules
    against masks.  A row a rule also for an empty ledger.
    """
    mask = mask_of(version)
    masks = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    aggregates = []
    for rule in POLICIES[version]:
        bit = RULES[rule]
        aggregates.append(F.struct(F.lit(rule).alias("rule"), F.coalesce(F.sum(F.when(F.col("m").bitwiseAND(F.lit(bit)) != 0, F.col("n"))), F.lit(0)).alias("n_failed"), F.coalesce(F.sum(F.when(F.col("m") == bit, F.col("n"))), F.lit(0)).alias("n_only")))
    return masks.agg(F.array(*aggregates).alias("a")).select(F.explode("a").alias("x")).select("x.*")
