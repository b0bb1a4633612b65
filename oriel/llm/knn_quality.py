"""Quality by nearest-neighbour voting in a latent-semantic space.

Fit: a bounded sample of labelled rows (``Fit.labelled`` per class, a parameter)
is turned into term vectors on the executors; the driver weights the terms,
takes the leading singular directions and keeps the sample's vectors.  Score:
the projection and the sample's vectors are broadcast (their size is fixed by
the parameters), and every document's exact cosine with every one of them is
computed in blocks; the nearest vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import Positions, chunks, text_or_empty, tidy, utf8_list
from .kernels import Words, factors

BYTES, SHAPES, EXTRA = 1024, 512, 48
TERMS = BYTES + SHAPES + EXTRA
#: Most texts, and bytes of texts, whose term vectors and cosines are in memory together.
TOGETHER, TOGETHER_BYTES = 256, 1 << 19


@dataclass(frozen=True)
class Fit:
    labelled: int = 1000  # most labelled rows of each class in the sample
    dimensions: int = 48
    neighbours: int = 25
    threshold: float = 0.3


def _shapes() -> np.ndarray:
    """Character classes: letters by case, digits, bytes of other scripts, white space; each sign is its own."""
    out = np.arange(256, dtype=np.int64)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[0x80:] = ord("a")
    out[[0x20, *range(0x09, 0x0E)]] = 0x20
    out[0x0A] = 0x0A
    return out


SHAPE = _shapes()


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Term vectors: hashed byte trigrams, trigrams of character classes, and how far words repeat."""
    out = np.zeros((len(texts), TERMS), np.float32)
    joined = np.frombuffer(b"  ".join(texts) + b"    ", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    owner = np.repeat(np.arange(len(texts)), size)
    # trigrams begin within a text, so none reaches into the next one
    own = np.flatnonzero(np.arange(len(owner)) < np.repeat(np.cumsum(size) - 2, size))
    f = factors(8, 7)
    shift = np.uint64(40)
    for data, places, offset in ((joined.astype(np.uint64), BYTES, 0), (SHAPE[joined].astype(np.uint64), SHAPES, BYTES)):
        h = (data[own] * f[0] + data[own + 1] * f[1] + data[own + 2] * f[2]) >> shift
        cell = owner[own] * places + (h % np.uint64(places)).astype(np.int64)
        out[:, offset : offset + places] = np.bincount(cell, minlength=len(texts) * places).reshape(len(texts), places)
    w = Words(texts)
    n = np.maximum(w.count, 1)

    def repeated(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Share of each text's values that occurred in it before."""
        both = np.lexsort((h, owner))
        again = (np.diff(h[both]) == 0) & (np.diff(owner[both]) == 0)
        return np.bincount(owner[both][1:][again], minlength=len(texts)) / np.maximum(1, np.bincount(owner, minlength=len(texts)))

    base = BYTES + SHAPES
    total = np.maximum(1.0, size - 2)
    if len(w.hash):
        same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        grams, start = w.grams(4)
        shares = (np.bincount(w.doc[1:][same], minlength=len(texts)) / n, repeated(w.hash, w.doc), repeated(grams, w.doc[start]))
    else:
        shares = (np.zeros(len(texts)),) * 3
    for k, share in enumerate(shares):  # each as one of eight levels
        level = np.minimum(7, (share * 8).astype(np.int64))
        out[np.arange(len(texts)), base + 8 * k + level] = total / 8
    level = np.minimum(23, np.log2(1 + w.count).astype(np.int64))
    out[np.arange(len(texts)), base + 24 + level] = total / 8
    return out


def weighted(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts, to length 1."""
    x = np.sqrt(counts)
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


@dataclass
class Model:
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray  # unit vectors of the sample
    labels: np.ndarray
    fit: Fit

    def score(self, counts: np.ndarray) -> np.ndarray:
        x = (weighted(counts) * self.idf) @ self.projection
        x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
        if not len(self.labels):
            return np.full(len(x), 0.5)
        near = x @ self.vectors.T
        k = min(self.fit.neighbours, near.shape[1])
        cut = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        vote = np.where(near >= cut - 1e-6, np.maximum(near, 0) ** 8 + 1e-12, 0)  # ties at the k-th place all vote, rounding aside
        return np.clip(vote @ self.labels / vote.sum(axis=1), 0, 1)


def train(counts: np.ndarray, labels: np.ndarray, fit: Fit) -> Model:
    if not len(labels):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, fit.dimensions), np.float32), np.zeros((0, fit.dimensions), np.float32), labels.astype(np.float32), fit)
    idf = (np.log((1 + len(labels)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = weighted(counts) * idf
    values, directions = np.linalg.eigh((x.T @ x).astype(np.float64))
    top = np.argsort(-values)[: fit.dimensions]
    # leading directions, evened out so that small but telling ones count
    projection = (directions[:, top] / np.sqrt(np.sqrt(np.maximum(values[top], 1e-9)))).astype(np.float32)
    v = x @ projection
    v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
    return Model(idf, projection, v.astype(np.float32), labels.astype(np.float32), fit)


def _vectors(batches):
    for b in batches:
        texts = utf8_list(b.column(1))
        for lo, hi in chunks(texts, TOGETHER_BYTES, TOGETHER):
            x = term_counts(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], ["y", "v"])


def fitted(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), key: str = "doc_id", label: str = "quality", text: str = "text") -> Model:
    """Fits on at most ``fit.labelled`` labelled rows of each class (those of smallest hash), never on held-out ones.

    A row is held out if crc32 of its identifier as text is divisible by 5;
    rows without identifier or label are passed over.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (F.crc32(F.col(key).cast("string")) % 5 != 0)).select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).distinct()
    sample = None
    for y in (0, 1):
        part = usable.where(F.col("__y") == y).orderBy(F.xxhash64("__k"), "__k").limit(fit.labelled)
        sample = part if sample is None else sample.unionByName(part)
    chosen = docs.select(F.col(key).alias("__k"), text_or_empty(text).alias("__t")).join(F.broadcast(sample), "__k")  # at most 2 * fit.labelled rows
    rows = chosen.select("__y", "__t").mapInArrow(tidy(_vectors), "y int, v binary").collect()
    rows.sort(key=lambda r: (r["y"], bytes(r["v"])))
    counts = np.frombuffer(b"".join(bytes(r["v"]) for r in rows), "<f4").reshape(len(rows), TERMS)
    return train(counts, np.array([r["y"] for r in rows], np.float32), fit)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and quality_score (double, 0 to 1): one row per input row.

    Null texts count as empty; empty texts have a length term like all others
    and are scored by it.  The score reads nothing but the whole text, so equal
    texts, repeated rows among them, score alike; null keys are scored too.  A
    column of docs named quality_score is replaced.  An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = Positions(docs)
    at, n = own.plain.index(own.of(text)), len(own.plain)
    # a text column is passed once; one of another type also as the text it reads as
    rows = own.rows if own.fields[at].dataType == T.StringType() else own.rows.withColumn("t", F.col(own.plain[at]).cast("string"))
    read = at if len(rows.columns) == n else n

    def run(batches):
        model = shared.value
        for b in batches:
            texts = utf8_list(b.column(read))
            out = np.zeros(len(texts))
            for lo, hi in chunks(texts, TOGETHER_BYTES, TOGETHER):
                out[lo:hi] = model.score(term_counts(texts[lo:hi]))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out, pa.float64())], [*b.schema.names[:n], "quality_score"])

    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(own.plain, own.fields, strict=True)] + [T.StructField("quality_score", T.DoubleType())])
    return own.back(rows.mapInArrow(tidy(run), schema), "quality_score")


def quality(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted for every row; fitted on the rows that are not held out.

    Rows with a null key are scored and are not held out; null texts count as
    empty; repeated rows keep a row each; without any usable label every score
    is 0.5; other columns are left out; an empty table gives no rows.
    """
    out = scored(docs.select(key, "text"), fitted(docs, labels, fit, key), key)
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))
    return out.select(key, held.alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= fit.threshold, 1).otherwise(0).cast("int").alias("predicted"))
