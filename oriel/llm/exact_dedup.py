"""Exact deduplication with a log-structured merge index of text digests.

Ingest: each task keeps a memtable (digest -> smallest identifier, count) and
flushes it as a sorted run when full; the runs of a batch are merged into one
level, a stored table sorted by digest with a Bloom filter of its digests.  A new
batch asks the filters of older levels first and merge-joins only what they let
through.  When levels are many, compaction merges them into one and keeps the
smallest identifier of every digest.  Hits, digests that stand twice or more,
receive byte verification: their texts are compared, so that a digest alone
never drops a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACE, Bloom, bloom_of, discard, text_or_empty, thinned, tidy, written

#: Entries of a memtable before it is flushed; levels before they are compacted.
MEMTABLE, LEVELS = 200_000, 4


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def digest_of(sha: str) -> Column:
    """The digest that stands for a text in the index, from its sha256 in hexadecimal."""
    return F.unhex(sha)


def flushed_runs(digests: DataFrame, memtable: int = MEMTABLE) -> DataFrame:
    """Sorted runs (digest, keep, n) of a table (digest binary, keep struct) of rows; a digest comes once in each run."""
    kind = digests.schema["keep"].dataType
    arrow = pa.struct([("anonymous", pa.bool_()), ("id", pa.int64()), ("row", pa.int64())])

    def run(batches):
        table: dict[bytes, list] = {}

        def flush():
            keys = sorted(table)
            keeps = pa.array([dict(zip(("anonymous", "id", "row"), table[k][0], strict=True)) for k in keys], arrow)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), keeps, pa.array([table[k][1] for k in keys], pa.int64())], ["digest", "keep", "n"])
            table.clear()
            return out

        for b in batches:
            keep = b.column(1)
            for d, anonymous, i, r in zip(b.column(0).to_pylist(), keep.field(0).to_pylist(), keep.field(1).to_pylist(), keep.field(2).to_pylist(), strict=True):
                new = (anonymous, i, r)
                have = table.get(d)
                if have is None:
                    table[d] = [new, 1]
                else:
                    have[1] += 1
                    if (new[0], new[1] or 0, new[2]) < (have[0][0], have[0][1] or 0, have[0][2]):
                        have[0] = new
            if len(table) >= memtable:
                yield flush()
        if table:
            yield flush()

    return digests.select("digest", "keep").mapInArrow(tidy(run), f"digest binary, keep {kind.simpleString()}, n long")


def compacted(*runs: DataFrame) -> DataFrame:
    """One sorted run of several: the smallest identifier and the whole count of each digest."""
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    return every.groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n")).sortWithinPartitions("digest")


@dataclass
class Level:
    """A stored run and the filter of its digests; none where that would be too large to broadcast."""

    run: DataFrame
    filter: Bloom | None

    @staticmethod
    def of(run: DataFrame) -> Level:
        run = written(run, "digest-run")
        return Level(run, bloom_of(run.select(F.xxhash64("digest").alias("h")), "h"))

    def holding(self, run: DataFrame) -> DataFrame:
        """Digests of ``run`` that this level holds too: the filter first, a merge join of what it lets through."""
        asked = run.select("digest", F.xxhash64("digest").alias("h"))
        if self.filter is not None:
            shared = run.sparkSession.sparkContext.broadcast(self.filter)

            def maybe(batches):
                for b in batches:
                    yield b.filter(pa.array(shared.value.has(b.column(1).to_numpy(zero_copy_only=False).view("uint64"))))

            asked = asked.mapInArrow(tidy(maybe), asked.schema)
        return asked.select("digest").hint("merge").join(self.run.select("digest"), "digest", "left_semi")


class DigestIndex:
    """Levels of sorted digest runs in the shared folder; batches are added, levels compacted."""

    def __init__(self, memtable: int = MEMTABLE, levels: int = LEVELS):
        self.levels: list[Level] = []
        self.memtable, self.most = memtable, levels

    def add(self, rows: DataFrame) -> DataFrame:
        """Adds a batch (digest, keep); returns the digests in it that it repeats or an older level holds."""
        flushed = written(flushed_runs(rows, self.memtable), "digest-memtables")
        fresh = Level.of(compacted(flushed))
        discard(flushed)
        hits = fresh.run.where("n > 1").select("digest")
        for level in self.levels:
            hits = hits.unionByName(level.holding(fresh.run))
        hits = written(hits.distinct(), "digest-hits")
        self.levels.append(fresh)
        if len(self.levels) > self.most:
            self.compact()
        return hits

    def compact(self) -> DataFrame:
        """Merges all levels into one; returns its run (digest, keep, n)."""
        if len(self.levels) != 1:
            old = self.levels
            self.levels = [Level.of(compacted(*[x.run for x in old]))]
            discard(*[x.run for x in old])
        return self.levels[0].run


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and equal each other and the empty text.  Of
    repeated rows with one identifier a single row is kept.  Rows with a null
    identifier come after all others; a group of none but such rows has a null
    keep_id and keeps one of them.  Whole texts of any length are compared;
    other columns are left out, whatever their names; an empty table gives no
    rows.  ``batches`` batches go into the index one after the other.
    """
    norm = normalised(text)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.sha2(norm, 256).alias("sha")).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "exact-digests").withColumn("digest", digest_of("sha"))
    index, hits = DigestIndex(), None
    entries = rows.select("digest", F.struct(F.col("id").isNull().alias("anonymous"), "id", "row").alias("keep"))
    for k in range(batches):
        found = index.add(entries.where(F.pmod(F.xxhash64("keep.id", "keep.row"), F.lit(batches)) == k))
        hits = found if hits is None else hits.unionByName(found)
    run = index.compact()

    # byte verification: a digest whose texts are all the same bytes is sound
    texts = docs.select(norm.alias("t")).select(F.sha2("t", 256).alias("sha"), "t").select(digest_of("sha").alias("digest"), "t")
    texts = texts.select(F.xxhash64("digest").alias("h"), "digest", "t")
    texts = thinned(texts, "h", written(hits.select(F.xxhash64("digest").alias("h")).distinct(), "hit-hashes"), "h").select("digest", "t")
    bounds = texts.groupBy("digest").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("n"))
    unsound = written(bounds.where("n > 1 and low <> high").select("digest"), "exact-collisions")

    out = rows.join(run, "digest")
    if not unsound.isEmpty():
        out = _resolved(docs, norm, out, unsound, key)
    return out.select(F.col("id").alias(key), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("keep.row") == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256"))


def _resolved(docs: DataFrame, norm: Column, out: DataFrame, unsound: DataFrame, key: str) -> DataFrame:
    """Groups by the bytes themselves where different texts share a digest.

    The rows of such digests are read and written anew, with row numbers of
    their own: numbers of an earlier scan need not come out again.
    """
    mine = docs.select(F.col(key).cast("long").alias("id"), norm.alias("t")).withColumn("sha", F.sha2("t", 256)).withColumn("digest", digest_of("sha"))
    mine = written(mine.join(unsound, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "exact-collided-rows")
    groups = mine.groupBy("digest", "t").agg(F.min(F.struct(F.col("id").isNull().alias("anonymous"), "id", "row")).alias("keep"), F.count("*").alias("n"))
    columns = ["digest", "id", "row", "sha", "keep", "n"]
    again = mine.join(groups, ["digest", "t"]).select(columns)
    return out.join(unsound, "digest", "left_anti").select(columns).unionByName(again)
