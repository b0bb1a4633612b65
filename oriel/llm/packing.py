"""Vector best-fit packing of tokenised documents into sequences.

A piece is a vector (tokens, one document, attention cost = tokens squared) and
a function of its length, so a histogram of lengths (at most ``tokens`` counts,
whatever the corpus) is all the driver needs.  There, lengths go in descending
order to the open bins that leave the smallest weighted residual norm under every
capacity, many equal bins at a time.  The plan says for every length which
ranks go to which sequence; pieces find their place by their rank among the
pieces of their length, which is a prefix sum over the written parts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import text_or_empty, tidy, written
from .bpe import encoded, encoder


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds.  Every piece has a token and a sum of squares is at most the square of the sum, so with
    these defaults tokens bind first, as a contract of the fewest sequences needs; smaller ones bind as they say."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)


def plan(counts: dict[int, int], capacity: Capacity = Capacity()) -> tuple[np.ndarray, int]:
    """Places ``counts[length]`` pieces of each length; returns the slots and the number of sequences.

    A slot row (length, first rank, sequence, pieces per bin, offset in the bin):
    ranks from ``first rank`` on fill bins from ``sequence`` on, so many a bin.
    """
    full = np.array([capacity.tokens, capacity.documents, capacity.cost], np.float64)
    weight = np.array(capacity.weights)
    left = np.zeros((1024, 3))  # of each group of equal open bins
    many = np.zeros(1024, np.int64)
    inside: list[list[tuple[int, int]]] = []

    def group(rest: np.ndarray, m: int, content: list[tuple[int, int]]) -> None:
        nonlocal left, many
        if len(inside) == len(many):
            left, many = np.concatenate((left, np.zeros_like(left))), np.concatenate((many, np.zeros_like(many)))
        left[len(inside)], many[len(inside)] = rest, m
        inside.append(content)

    for size in sorted(counts, reverse=True):
        need = np.array([size, 1, size * size], np.float64)
        if (need > full).any():
            raise ValueError(f"a piece of {size} tokens fits no sequence")
        todo = counts[size]
        while todo:
            n = len(inside)
            fits = np.flatnonzero((many[:n] > 0) & (left[:n] >= need).all(axis=1))
            if len(fits):
                norm = (weight * ((left[fits] - need) / full) ** 2).sum(axis=1)
                g = int(fits[np.argmin(norm)])
                rest, m, content = left[g].copy(), int(many[g]), inside[g]
            else:
                g, rest, m, content = -1, full.copy(), todo, []
            each = int(min((rest // need).min(), todo))
            bins = min(m, todo // each)
            if g >= 0:
                many[g] -= bins
            group(rest - each * need, bins, [*content, (size, each)])
            todo -= bins * each
    slots, sequence, used = [], 0, {}
    for m, content in zip(many[: len(inside)].tolist(), inside, strict=True):
        if not m:
            continue
        offset = 0
        for size, each in content:
            slots.append((size, used.get(size, 0), sequence, each, offset))
            used[size] = used.get(size, 0) + m * each
            offset += size * each
        sequence += m
    return np.array(sorted(slots), np.int64).reshape(-1, 5), sequence


def pieces(docs: DataFrame, capacity: Capacity, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with the rank of each among its task's pieces of the same length."""
    size = capacity.tokens
    kind = dict(docs.dtypes)[key]
    end = end_id.to_bytes(4, "little")
    names = ["k", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64).tolist()
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        enc = encoder(path)
        for batch in batches:
            at, rows = [], []
            for i, ids in encoded(enc, batch.column(1)):
                ids += end
                n = len(ids) // 4
                first = n % size or size
                cut = [0, *range(first, n + 1, size)]
                for p in range(len(cut) - 1):
                    lo, hi = cut[p], cut[p + 1]
                    at.append(i)
                    rows.append((p, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi]), part, seen[hi - lo]))
                    seen[hi - lo] += 1
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names)

    return docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(tidy(run), f"k {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def packed(docs: DataFrame, capacity: Capacity = Capacity(), key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty; an empty text is one piece, its end id.  Repeated rows
    and rows with a null key are packed each.  Only documents longer than a
    sequence are cut: a first piece of what is over, then whole sequences; a
    text of any length is encoded whole.  Ties between equal bins go to the
    first.  Columns other than key and text are left out, whatever their names.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = written(pieces(docs, capacity, key, text, path), "pieces")
    by_part = written(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity.tokens rows
    slots, _ = plan(counts, capacity)
    shared = spark.sparkContext.broadcast(slots)
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    # as many offsets as tasks times lengths: they grow with the corpus, so this is a merge join at every size
    ranked = rows.join(written(before, "piece-offsets").hint("merge"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))

    def place(batches):
        own = shared.value
        first = own[:, 0] << 44 | own[:, 1] if len(own) else np.zeros(0, np.int64)
        for b in batches:
            length, rank = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = np.searchsorted(first, length << 44 | rank, "right") - 1
            j = rank - own[at, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], b.column(0), pa.array(own[at, 2] + j // own[at, 3]), pa.array(own[at, 4] + j % own[at, 3] * length)], ["k", "piece", "start", "ids_crc32", "length", "sequence_id", "offset"])

    kind = dict(docs.dtypes)[key]
    out = ranked.select("length", "rank", "k", "piece", "start", "ids_crc32").mapInArrow(tidy(place), f"k {kind}, piece int, start long, ids_crc32 long, length long, sequence_id long, offset long")
    return out.select(F.col("k").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
