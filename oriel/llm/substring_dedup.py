"""Removal of repeated word windows with a log-structured fingerprint index.

1. Fingerprints.  Of the 12-word grams within each window of 35 words the one of
   least hash stands for the window, so equal windows have equal fingerprints
   and a twelfth of the positions are indexed.  Each batch becomes an immutable
   run (fingerprint, occurrences) sorted by fingerprint; it is merge-joined
   with the compacted history, which gives the next history.
2. Candidates.  Fingerprints that occur twice or more mark the windows to look at:
   by a Bloom filter as long as that is small, by a merge join beyond.  It only
   thins out the next step: a window let through wrongly costs a comparison,
   none is held back.
3. Verification.  Candidate windows are compared by 96 bits of a cryptographic
   digest of their words, dealt into buckets of about one size by fingerprint.  A
   block of documents sends each of its windows to its bucket once; blocks form
   groups, buckets are settled group by group and then over groups, so what a
   bucket holds of one window is bounded whatever share of all documents has it.
4. Words covered by a repeated window are removed.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import MOST_BITS, Positions, bloom_of, chunks, discard, text_or_empty, tidy, utf8_list, written
from .kernels import Words

WINDOW, GRAM = 35, 12
#: Windows that a bucket of the verification holds on average; input partitions whose blocks form a group.
BUCKET, GROUP = 1 << 17, 256
_NONE = -(2**63)


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    have, size = h, 1
    while size * 2 <= width:
        have = np.minimum(have[: len(have) - size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def fingerprints(words: Words, window: int, gram: int):
    """Start word and fingerprint of every window, and the hashes of all grams."""
    total = len(words.hash)
    if total < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = np.full(total - gram + 1, 2**64 - 1, np.uint64)
    h, at = words.runs(gram, 3)
    grams[at] = h  # a gram that would cross two texts never is the least one of a window within a text
    start = np.flatnonzero(words.doc[: total - window + 1] == words.doc[window - 1 :])
    return start, least(grams, window - gram + 1)[start], h


def run_of(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The sorted run (fp, n) of a batch of documents; n counts places of the
    gram in the blocks that index it: two at least if a window of it repeats."""

    def emit(batches):
        for b in batches:
            texts = utf8_list(b.column(0))
            for lo, hi in chunks(texts, 2 << 20):
                _, prints, grams = fingerprints(Words(texts[lo:hi]), window, gram)
                if not len(prints):
                    continue
                keys = np.unique(prints[np.concatenate(([True], prints[1:] != prints[:-1]))])
                grams = np.sort(grams)
                n = np.searchsorted(grams, keys, "right") - np.searchsorted(grams, keys, "left")
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["fp", "n"])

    found = docs.select(text_or_empty(text).alias("t")).mapInArrow(tidy(emit), "fp long, n long")
    return found.groupBy("fp").agg(F.sum("n").alias("n")).sortWithinPartitions("fp")


class FingerprintIndex:
    """Immutable sorted runs in the shared folder, and their compaction."""

    def __init__(self, history: DataFrame | None = None, window: int = WINDOW, gram: int = GRAM):
        self.history, self.window, self.gram = history, window, gram
        self._stored: DataFrame | None = None

    def add(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Indexes a batch; returns its fingerprints that the history or the batch itself repeats."""
        run = written(run_of(docs, text, self.window, self.gram), "fingerprint-run")
        if self.history is None:
            self.history = self._stored = run
            return run.where("n > 1").select("fp")
        old = self.history.withColumnRenamed("n", "before")
        merged = run.join(old, "fp", "full_outer").select("fp", (F.coalesce("n", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("n"), F.col("n").isNotNull().alias("new"))
        merged = written(merged, "fingerprint-history")
        discard(run)
        self.history, self._stored = merged.select("fp", "n"), merged
        return merged.where("new and n > 1").select("fp")

    def repeated(self) -> DataFrame:
        return self.history.where("n > 1").select("fp")


def _digests(w: Words, texts: list[bytes], at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of a digest of the words of the windows that begin at ``at``."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    size = w.end - w.start
    # all words, one space after each
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    first = np.cumsum(size + 1) - size - 1
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(first, size) + offset] = data[np.repeat(w.start, size) + offset]
    flat = out.tobytes()
    lows, highs = first[at].tolist(), (first[at + window - 1] + size[at + window - 1]).tolist()
    raw = np.frombuffer(b"".join([blake2b(flat[x:y], digest_size=12).digest() for x, y in zip(lows, highs, strict=True)]), np.dtype([("one", "<u8"), ("two", "<u4")]))
    return raw["one"].copy(), raw["two"].copy()


def _requests(sieve, buckets: int, groups: int, window: int, gram: int):
    """Rows (bucket, i, tk, blob): with i null the windows of a block for a bucket, else places known to repeat.

    Batches have columns i, tk, t and, without a filter, the sorted repeated fingerprints of each text.
    """

    def emit(batches):
        from pyspark import TaskContext

        own, group = sieve.value, TaskContext.get().partitionId() % groups
        for b in batches:
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            texts = utf8_list(b.column(2))
            for lo, hi in chunks(texts, 2 << 20):
                w = Words(texts[lo:hi])
                start, prints, _ = fingerprints(w, window, gram)
                if not len(start):
                    continue
                change = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
                if own is not None:
                    asked = own.has(prints[change])
                else:
                    known = b.column(3).slice(lo, hi - lo)
                    flat = known.flatten().to_numpy(zero_copy_only=False).view(np.uint64) if len(known) else np.zeros(0, np.uint64)
                    asked = np.isin(prints[change], flat)
                use = np.repeat(asked, np.diff(change, append=len(prints)))
                at, prints = start[use], prints[use]
                if not len(at):
                    continue
                one, two = _digests(w, texts[lo:hi], at, window)
                order = np.lexsort((at, two, one))
                a, t = one[order], two[order]
                head = np.concatenate(([True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])))
                count = np.diff(np.flatnonzero(head), append=len(a))
                first, again = order[head], np.repeat(count > 1, count)
                doc = w.doc[at]
                place = (at - w.first[doc]).astype(np.uint32)
                out: list[tuple] = []
                here = np.sort(order[again])
                if len(here):
                    for piece in np.split(here, np.flatnonzero(np.diff(doc[here])) + 1):
                        d = lo + int(doc[piece[0]])
                        out.append(((int(ids[d]) * 2654435761 + int(keys[d])) % buckets, int(ids[d]), int(keys[d]), place[piece].tobytes()))
                # equal windows have one fingerprint, neighbours mostly too: few buckets for each document
                bucket = (prints[first] % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                first, bucket, seen = first[by], bucket[by], (count > 1)[by]
                for lo2, hi2 in zip(cut := np.flatnonzero(np.diff(bucket, prepend=-1)), np.append(cut[1:], len(bucket)), strict=True):
                    x = first[lo2:hi2]
                    d = lo + doc[x]
                    entry = np.rec.fromarrays([one[x], two[x], ids[d], keys[d], place[x], seen[lo2:hi2]], dtype=_ENTRY)
                    out.append((int(bucket[lo2]), None, None, entry.tobytes()))
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array([group] * len(out), pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary())], ["bucket", "g", "i", "tk", "blob"])

    return emit


_ENTRY = np.dtype([("one", "<u8"), ("two", "<u4"), ("i", "<i8"), ("tk", "<i8"), ("at", "<u4"), ("seen", "?")])
_PLACES = "bucket long, i long, tk long, blob binary"


def _verified(last: bool):
    """Of a bucket's rows: places (i, tk, blob) of windows that stand elsewhere too, and if it isn't the last word one entry for each window, i null."""

    def settle(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        known = group.filter(pa.compute.is_valid(group.column("i")))
        e = np.concatenate([np.frombuffer(x, _ENTRY) for x in group.filter(pa.compute.is_null(group.column("i"))).column("blob").to_pylist()] or [np.zeros(0, _ENTRY)])
        i, tk, blobs = known.column("i").to_pylist(), known.column("tk").to_pylist(), known.column("blob").to_pylist()
        if len(e):
            e = e[np.lexsort((e["two"], e["one"]))]
            same = (e["one"][1:] == e["one"][:-1]) & (e["two"][1:] == e["two"][:-1])
            hit = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            if not last:
                up = e[np.concatenate(([True], ~same))].copy()
                up["seen"] |= hit[np.concatenate(([True], ~same))]
                i.append(None)
                tk.append(None)
                blobs.append(up.tobytes())
            e = e[hit & ~e["seen"]]
            e = e[np.lexsort((e["at"], e["tk"], e["i"]))]
            if len(e):
                cut = np.flatnonzero(np.concatenate(([True], (e["i"][1:] != e["i"][:-1]) | (e["tk"][1:] != e["tk"][:-1]))))
                for lo, hi in zip(cut, np.append(cut[1:], len(e)), strict=True):
                    i.append(int(e["i"][lo]))
                    tk.append(int(e["tk"][lo]))
                    blobs.append(e["at"][lo:hi].tobytes())
        return pa.table({"bucket": pa.array([bucket] * len(i), pa.int64()), "i": pa.array(i, pa.int64()), "tk": pa.array(tk, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return settle


def repeated_places(docs: DataFrame, index: FingerprintIndex, most_bits: int = MOST_BITS) -> DataFrame:
    """(i, tk, places): word places at which a window begins that stands elsewhere too.  docs: (i, tk, t)."""
    spark, window, gram = docs.sparkSession, index.window, index.gram
    sieve = bloom_of(index.repeated(), "fp", most_bits)
    # a fingerprint stands for about (window - gram + 2) / 2 windows at each of its places
    places = index.history.where("n > 1").agg(F.sum("n")).first()[0] or 0
    buckets = max(16, int(places * (window - gram + 2) / 2 / BUCKET))
    groups = -(-((docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1) // GROUP)
    if sieve is None:

        def prints(batches):
            for b in batches:
                texts = utf8_list(b.column(2))
                for lo, hi in chunks(texts, 2 << 20):
                    w = Words(texts[lo:hi])
                    start, found, _ = fingerprints(w, window, gram)
                    pair = np.unique(np.rec.fromarrays([w.doc[start], found], names="d,f")) if len(start) else np.zeros(0, [("d", "<i8"), ("f", "<u8")])
                    at = pa.array(pair["d"] + lo)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(pair["f"].astype(np.uint64).view(np.int64))], ["i", "tk", "fp"])

        marked = docs.select("i", "tk", "t").mapInArrow(tidy(prints), "i long, tk long, fp long").join(index.repeated().hint("merge"), "fp", "left_semi")
        marked = marked.groupBy("i", "tk").agg(F.collect_set("fp").alias("fps"))  # bounded by the document's own length
        docs = docs.join(marked.hint("merge"), ["i", "tk"]).select("i", "tk", "t", "fps")
    else:
        docs = docs.select("i", "tk", "t")
    shared = spark.sparkContext.broadcast(sieve)
    asked = docs.mapInArrow(tidy(_requests(shared, buckets, groups, window, gram)), "bucket long, g long, i long, tk long, blob binary")
    if groups == 1:
        found = asked.select("bucket", "i", "tk", "blob").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_verified(True), _PLACES)
    else:
        first = asked.repartition(buckets, "bucket", "g").groupBy("bucket", "g").applyInArrow(_verified(False), _PLACES)
        first = written(first, "settled-in-groups")
        found = first.where("i is null").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_verified(True), _PLACES).unionByName(first.where("i is not null"))
    return found.groupBy("i", "tk").agg(F.collect_list("blob").alias("places"))  # bounded by the document's own length


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, batches: int = 2, most_bits: int = MOST_BITS) -> DataFrame:
    """All columns of ``docs``, with n_words, n_removed, kept_words and kept_text added.

    kept_words: the kept words joined by one space; kept_text: the text without
    the removed words and the white space after them, as it was where nothing
    is removed.  Null texts count as empty.  Texts of fewer words than a window
    lose nothing; a repeated row is a repetition; null keys are one key.  Whole
    texts of any length take part.  Columns of docs named like an added one are
    replaced.  An empty table gives no rows.
    """
    index = FingerprintIndex(window=window)
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(batches))
    for b in range(batches):
        index.add(docs.where(part == b), text)
    own = Positions(docs)
    k, t = own.of(key), own.of(text)
    i, tk = F.coalesce(F.col(k).cast("long"), F.lit(_NONE)), F.xxhash64(text_or_empty(t))
    found = repeated_places(own.rows.select(i.alias("i"), tk.alias("tk"), text_or_empty(t).alias("t")), index, most_bits)
    plain, n = own.plain, len(own.plain)
    # a text column travels once; one of another type also as the text it reads as
    at = plain.index(t) if own.fields[plain.index(t)].dataType == T.StringType() else n + 1
    rows = own.rows.withColumns({"i": i, "tk": tk} | ({} if at < n else {"t": text_or_empty(t)}))
    rows = rows.join(found, ["i", "tk"], "left").select(*plain, "places", *[] if at < n else ["t"])

    def apply(parts):
        for b in parts:
            texts, places = utf8_list(b.column(at)), b.column(n).to_pylist()
            for lo, hi in chunks(texts, 2 << 20):
                w = Words(texts[lo:hi])
                total, removed, words, kept = [], [], [], []
                for k in range(hi - lo):
                    raw, first, count = texts[lo + k], int(w.first[k]), int(w.count[k])
                    total.append(count)
                    if not places[lo + k]:
                        removed.append(0)
                        words.append(b" ".join(raw.split()))
                        kept.append(raw)
                        continue
                    edge = np.zeros(count + 1, np.int64)
                    spots = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in places[lo + k]])).astype(np.int64)
                    edge[spots] += 1
                    np.subtract.at(edge, spots + window, 1)
                    gone = np.cumsum(edge[:count]) > 0
                    begin = w.start[first : first + count] - w.text_at[k]
                    follow = np.append(begin[1:], len(raw))
                    split = raw.split()
                    removed.append(int(gone.sum()))
                    words.append(b" ".join([split[j] for j in np.flatnonzero(~gone)]))
                    stay = np.concatenate(([True], ~gone))  # what stands before the first word stays
                    lows, highs = np.concatenate(([0], begin)), np.concatenate((begin[:1], follow))
                    kept.append(b"".join([raw[x:y] for x, y in zip(lows[stay], highs[stay], strict=True)]).rstrip(b" \t\r\x0b\x0c\n"))
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in range(n)], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], [*plain, *_ADDED])

    schema = T.StructType([T.StructField(c, f.dataType) for f, c in zip(own.fields, plain, strict=True)] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_words", T.StringType()), T.StructField("kept_text", T.StringType())])
    return own.back(rows.mapInArrow(tidy(apply), schema), *_ADDED)


_ADDED = ("n_words", "n_removed", "kept_words", "kept_text")
