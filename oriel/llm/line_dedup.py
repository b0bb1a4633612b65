"""Line deduplication by pairwise alignment.

Documents overlap where they share hashes of telling lines (rare ones: at least
``min_words`` words).  Each pair is aligned by patience diff on line hashes, and
common blocks of at least ``min_words`` words are deleted from the later
document.  The result is that of aligning with every earlier overlapping
document, but most pairs are never made:

* Whatever is deleted lies in a window, the fewest neighbouring lines around a
  line that hold ``min_words`` words, and the earlier document holds that
  window too.  In round 1 a later document meets the earliest holder of each of
  its windows, so a line that a third of all documents share gives a pair for
  each of them and no more.
* Windows with a line that stays go on: in round 2 to ``FEW`` further holders,
  in round 3 to all.  Holders that differ only in lines which no document still
  in question has align with these alike; only the earliest of them is met.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import SPACE, Bloom, Positions, bloom_of, chunks, discard, text_or_empty, tidy, utf8_list, written

_NONE = -(2**63)
#: Holders of a window that round 2 tries. Decides only how much is left to round 3, which tries all.
FEW = 8
_LEFT = "array<struct<x: long, lo: int, n: int>>"
#: Values a task gathers before it hands them on.
HELD = 1 << 17


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, v in enumerate(values):
        p = bisect_left(tops, v)
        if p == len(tops):
            tops.append(v)
            at.append(k)
        else:
            tops[p], at[p] = v, k
        back.append(at[p - 1] if p else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched index pairs of two lists of line hashes, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i >= ie or j >= je:
            continue
        left, right = Counter(a[i:ie]), Counter(b[j:je])
        where = {v: k for k, v in enumerate(b[j:je], j) if right[v] == 1}
        once = [(k, where[v]) for k, v in enumerate(a[i:ie], i) if left[v] == 1 and v in where]
        if not once:
            continue
        chain = [once[k] for k in _increasing([y for _, y in once])]
        x, y = i, j
        for p, q in [*chain, (ie, je)]:
            if x < p and y < q:
                todo.append((x, p, y, q))
            if p < ie:
                out.append((p, q))
            x, y = p + 1, q + 1
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Lines of ``a`` in aligned blocks that hold at least ``min_words`` words; ``words`` are those of a's lines."""
    gone: list[int] = []
    block: list[int] = []
    last = None
    for i, j in [*patience(a, b), (-9, -9)]:
        if last is None or (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= min_words:
                gone += block
            block = []
        block.append(i)
        last = (i, j)
    return gone


def windows(h: list[int], words: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(hash, first line, lines) of each window: for every line the shortest that begin or end there and have ``min_words`` words."""
    out = []
    for k, n in enumerate(words):
        if n >= min_words:
            out.append((h[k], k, 1))
            continue
        j, total = k, n
        while total < min_words and j + 1 < len(h):
            j += 1
            total += words[j]
        if total >= min_words:
            out.append((hash(tuple(h[k : j + 1])), k, j + 1 - k))
        j, total = k, n
        while total < min_words and j:
            j -= 1
            total += words[j]
        if total >= min_words:
            out.append((hash(tuple(h[j : k + 1])), j, k + 1 - j))
    return out


def lists(column: pa.Array):
    """The lists of a column of numbers, one at a time: as Python numbers a batch takes many times its size."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lo = 0
    for hi in np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64).tolist():
        yield flat[lo:hi].tolist()
        lo = hi


def _postings(arrays: DataFrame, min_words: int) -> DataFrame:
    """(d, x): the windows of each document."""

    def run(batches):
        for b in batches:
            lo, held, found = 0, 0, []
            for k, (h, w) in enumerate(zip(lists(b.column(2)), lists(b.column(3)), strict=True), 1):
                found.append(list({x for x, _, _ in windows(h, w, min_words)}))
                held += len(found[-1])
                if held >= HELD or k == len(b):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, k - lo), b.column(1).slice(lo, k - lo), pa.array(found, pa.list_(pa.int64()))], ["i", "tk", "x"])
                    lo, held, found = k, 0, []

    return arrays.select("i", "tk", "h", "w").mapInArrow(tidy(run), "i long, tk long, x array<long>").select(F.struct("i", "tk").alias("d"), F.explode("x").alias("x"))


def _holders(arrays: DataFrame, asked: Bloom | None, lines: Bloom | None, min_words: int) -> DataFrame:
    """(x, c, e): documents with windows in ``asked``; ``c`` is the same where they are the same but for lines outside ``lines``.

    What the filters let through by mistake only parts documents that need not be apart.
    """

    shared = arrays.sparkSession.sparkContext.broadcast((asked, lines))

    def run(batches):
        asked, lines = shared.value
        for b in batches:
            h = b.column(2)
            flat, ends = h.flatten().to_numpy(zero_copy_only=False), np.cumsum(h.value_lengths().to_numpy(zero_copy_only=False))
            known = lines.has(flat.view(np.uint64)) if lines else np.ones(len(flat), bool)
            before = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], ends])]
            i, tk, c, x = [], [], [], []
            for k in np.flatnonzero(np.diff(before)):
                if len(x) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (i, tk, c, x)], ["i", "tk", "c", "x"])
                    i, tk, c, x = [], [], [], []
                lo, hi = int(ends[k - 1]) if k else 0, int(ends[k])
                own = flat[lo:hi]
                found = np.array(list({y for y, _, _ in windows(own.tolist(), b.column(3)[int(k)].as_py(), min_words)}), np.int64)
                found = found[asked.has(found.view(np.uint64))] if asked else found
                if not len(found):
                    continue
                # runs of unknown lines become one mark
                on = known[lo:hi]
                stay = on | np.concatenate([[True], on[:-1]])
                shape = hashlib.blake2b(np.where(on, own, 0)[stay].tobytes() + on[stay].tobytes(), digest_size=8).digest()
                i += [b.column(0)[int(k)].as_py()] * len(found)
                tk += [b.column(1)[int(k)].as_py()] * len(found)
                c += [int.from_bytes(shape, "little", signed=True)] * len(found)
                x += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (i, tk, c, x)], ["i", "tk", "c", "x"])

    return arrays.select("i", "tk", "h", "w").mapInArrow(tidy(run), "i long, tk long, c long, x long").select("x", "c", F.struct("i", "tk").alias("e"))


def _aligned(pairs: DataFrame, arrays: DataFrame, min_words: int) -> DataFrame:
    """(i, tk, gone, left) of pairs (d, e, x): lines that go from d, and the windows of ``x`` with a line that stays."""

    windows_left = pa.list_(pa.struct([("x", pa.int64()), ("lo", pa.int32()), ("n", pa.int32())]))

    def run(batches):
        for b in batches:
            lo, held, gone, left = 0, 0, [], []
            for k, (h, w, other, asked) in enumerate(zip(*(lists(b.column(c)) for c in range(2, 6)), strict=True), 1):
                common = set(other)
                out = common_blocks(h, other, w, min_words) if any(n >= min_words and y in common for y, n in zip(h, w, strict=True)) else []
                gone.append(out)
                out, asked = set(out), set(asked)
                stays = [] if len(out) == len(h) else windows(h, w, min_words)
                left.append([{"x": x, "lo": at, "n": n} for x, at, n in stays if x in asked and not out.issuperset(range(at, at + n))])
                held += len(gone[-1]) + 8 * len(left[-1])
                if held >= HELD or k == len(b):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, k - lo), b.column(1).slice(lo, k - lo), pa.array(gone, pa.list_(pa.int32())), pa.array(left, windows_left)], ["i", "tk", "gone", "left"])
                    lo, held, gone, left = k, 0, [], []

    one = pairs.groupBy("d", "e").agg(F.collect_set("x").alias("x")).select(F.col("d.i").alias("i"), F.col("d.tk").alias("tk"), F.col("e.i").alias("ei"), F.col("e.tk").alias("etk"), "x")
    other = arrays.select(F.col("i").alias("ei"), F.col("tk").alias("etk"), F.col("h").alias("eh"))
    both = written(one, "overlaps").join(arrays, ["i", "tk"]).join(other, ["ei", "etk"]).select("i", "tk", "h", "w", "eh", "x")
    return written(both.mapInArrow(tidy(run), f"i long, tk long, gone array<int>, left {_LEFT}").where("size(gone) > 0 or size(left) > 0"), "aligned")


def _gone(aligned: DataFrame) -> DataFrame:
    """(i, tk, gone): every line that some alignment deletes, once; no more than the document has."""
    return aligned.select("i", "tk", F.explode("gone").alias("g")).groupBy("i", "tk").agg(F.collect_set("g").alias("gone"))


def _left(aligned: DataFrame, gone: DataFrame) -> DataFrame:
    """(d, x) of the windows with a line that stays after all alignments."""
    rows = aligned.where("size(left) > 0").select("i", "tk", F.explode("left").alias("l")).join(gone, ["i", "tk"], "left")
    stays = F.exists(F.sequence("l.lo", F.col("l.lo") + F.col("l.n") - 1), lambda k: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), k))
    return written(rows.where(stays).select(F.struct("i", "tk").alias("d"), F.col("l.x").alias("x")).distinct(), "left-windows")


def _deletions(arrays: DataFrame, min_words: int) -> DataFrame:
    """(i, tk, gone) by rounds of alignments."""
    postings = _postings(arrays, min_words)
    # windows in two documents or more, and the earliest holder of each
    shared = written(postings.groupBy("x").agg(F.min("d").alias("e"), F.max("d").alias("z")).where("e <> z").select("x", "e"), "shared-lines")
    aligned = _aligned(postings.join(shared, "x").where("d <> e"), arrays, min_words)
    gone = written(_gone(aligned), "deleted-lines")
    left = _left(aligned, gone)
    for few in (FEW, None):
        if left.isEmpty():
            break
        asked = left.select("d.i", "d.tk").distinct().join(arrays, ["i", "tk"]).select(F.explode("h").alias("h"))
        holders = _holders(arrays, _filter(left.select("x"), "x"), _filter(asked, "h"), min_words)
        alike = F.col("c") if few is None else F.pmod(F.col("c"), F.lit(few))
        met = holders.groupBy("x", alike.alias("c")).agg(F.min("e").alias("e"))
        further = _aligned(left.join(met, "x").where("e < d").select("d", "e", "x"), arrays, min_words)
        aligned = aligned.unionByName(further)
        gone = written(_gone(aligned), "deleted-lines")
        if few is not None:
            left = _left(further, gone)
    discard(shared)
    return gone


def _filter(keys: DataFrame, column: str) -> Bloom | None:
    """None where the filter would be too large to broadcast: then every key counts as known."""
    return bloom_of(written(keys.distinct(), "line-keys"), column)


def without_shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 5) -> DataFrame:
    """All columns of ``docs``, with n_lines, n_removed and kept_text added.

    Lines are equal when their words are (compared by a 64-bit hash, within two
    documents that share a window of lines); lines without a word are never
    compared and never deleted.  Earlier means a smaller identifier (null
    first, then by the text's hash).  Null texts count as empty.  Repeated rows
    (same identifier and text) are one document and stay as they are.  Whole
    texts of any length are aligned.  Columns of docs named like an added one
    are replaced.  An empty table gives no rows.
    """
    own = Positions(docs)
    k, t = own.of(key), own.of(text)
    i, tk = F.coalesce(F.col(k).cast("long"), F.lit(_NONE)), F.xxhash64(text_or_empty(t))
    plain = F.transform(F.split(text_or_empty(t), "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))
    lines = own.rows.select(i.alias("i"), tk.alias("tk"), F.filter(plain, lambda x: x != "").alias("l")).where(F.size("l") > 0)
    arrays = lines.select("i", "tk", F.transform("l", lambda x: F.xxhash64(x)).alias("h"), F.transform("l", lambda x: (F.length(x) - F.length(F.translate(x, " ", "")) + 1).cast("int")).alias("w"))
    arrays = written(arrays.dropDuplicates(["i", "tk"]), "line-hashes")
    gone = _deletions(arrays, min_words)

    names, n, at = own.plain, len(own.plain), own.plain.index(t)
    as_text = own.fields[at].dataType == T.StringType()  # else its text travels too
    rows = own.rows.withColumns({"i": i, "tk": tk} | ({} if as_text else {"t": text_or_empty(t)}))
    # always by merge: the deletions grow with the documents, so the plan is the same at every size
    rows = rows.join(gone.hint("merge"), ["i", "tk"], "left").select(*own.plain, "gone", *[] if as_text else ["t"])

    def apply(batches):
        for whole in batches:
            texts = utf8_list(whole.column(at if as_text else n + 1))
            for lo, hi in chunks(texts):
                b = whole.slice(lo, hi - lo)
                total, removed, kept = [], [], []
                for raw, away in zip(texts[lo:hi], b.column(n).to_pylist(), strict=True):
                    split = raw.split(b"\n")
                    worded = [bool(x.strip(_WHITE)) for x in split]
                    total.append(sum(worded))
                    removed.append(len(away or ()))
                    if away:
                        off, number, stay = set(away), -1, []
                        for line, has in zip(split, worded, strict=True):
                            number += has
                            if not (has and number in off):
                                stay.append(line)
                        raw = b"\n".join(stay)
                    kept.append(raw)
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())], [*names, *_ADDED])

    schema = T.StructType([T.StructField(c, f.dataType) for f, c in zip(own.fields, own.plain, strict=True)] + [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return own.back(rows.mapInArrow(tidy(apply), schema), *_ADDED)


_ADDED = ("n_lines", "n_removed", "kept_text")
_WHITE = b" \t\n\x0b\x0c\r"
