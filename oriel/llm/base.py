"""What the operators share: the shared folder, written tables, key filters, columns by position."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: U+0020 and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Bits of the largest filter that is broadcast (16 MB), and bits for each key.
MOST_BITS, BITS_A_KEY = 1 << 27, 12

_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_LEFT_BEHIND: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where a local master names none (tests) a temporary folder is set; on a
    cluster that would be a folder others cannot see, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = os.environ.get("ORIEL_SHARED_DIR")
        if not named and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = named or tempfile.mkdtemp(prefix="oriel-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except (Py4JError, OSError, AttributeError):
        pass  # the session ended first: the folder stays for whoever owns the shared one


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage: a lost executor costs its tasks, never the whole chain.
    The table goes with ``discard`` or at the end of the driver.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/oriel-tables/{spark.sparkContext.applicationId}"
    if folder not in _LEFT_BEHIND:
        _LEFT_BEHIND.add(folder)
        atexit.register(_remove_at_exit, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing will read again."""
    for t in tables:
        if t is not None and (path := _FOLDERS.pop(t, None)):
            _remove(t.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


class Positions:
    """Columns by position, so that names of the caller's never meet the operator's own."""

    def __init__(self, docs: DataFrame):
        self.fields = docs.schema.fields
        self.plain = [f"c{k}" for k in range(len(self.fields))]
        self.rows = docs.toDF(*self.plain)

    def of(self, name: str) -> str:
        """The plain name of a column."""
        at = [k for k, f in enumerate(self.fields) if f.name == name] or [k for k, f in enumerate(self.fields) if f.name.lower() == name.lower()]
        if len(at) != 1:
            raise ValueError(f"{len(at)} columns are named {name}")
        return self.plain[at[0]]

    def back(self, rows: DataFrame, *added: str) -> DataFrame:
        """The caller's columns under their names, then ``added``, which replace columns of the same name."""
        mine = {a.lower() for a in added}
        return rows.select(*[F.col(c).alias(f.name) for c, f in zip(self.plain, self.fields, strict=True) if f.name.lower() not in mine], *added)


def utf8_list(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = 1 << 20, rows: int = 1 << 14):
    """Index ranges of at most ``rows`` neighbouring texts of about ``most`` bytes together; a longer text stands alone."""
    lo, size = 0, 0
    for i, x in enumerate(texts):
        if size and (size + len(x) > most or i - lo == rows):
            yield lo, i
            lo, size = i, 0
        size += len(x) + 1
    if lo < len(texts):
        yield lo, len(texts)


def _give_back() -> None:
    """Returns memory that the worker has freed but still holds to the system, as far as its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """``run`` for ``mapInArrow``, after which the worker, which outlives the task, holds no more than it uses."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return whole


class Bloom:
    """A Bloom filter over mixed 64-bit hashes, in slices of at most 2^20 bits that are built apart."""

    SLICE = 1 << 20

    def __init__(self, bits: int):
        self.each = min(bits, self.SLICE)  # both are powers of two
        self.slices = bits // self.each
        self.words = np.zeros((self.slices, self.each // 8), np.uint8)

    def slice_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(40)).astype(np.int64) % self.slices

    def _places(self, keys: np.ndarray):
        mask = np.uint64(self.each - 1)
        base = self.slice_of(keys) * self.each
        yield base + (keys & mask).astype(np.int64)
        yield base + ((keys >> np.uint64(20)) & mask).astype(np.int64)
        yield base + (((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)) & mask).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        flat = self.words.reshape(-1)
        for at in self._places(keys):
            np.bitwise_or.at(flat, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out, flat = np.ones(len(keys), bool), self.words.reshape(-1)
        for at in self._places(keys):
            out &= (flat[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def bits_for(n: int) -> int:
    return 1 << max(10, (BITS_A_KEY * max(n, 1) - 1).bit_length())


def bloom_of(keys: DataFrame, column: str, most: int = MOST_BITS) -> Bloom | None:
    """The Bloom filter of a long column of mixed hashes; None if it would have more than ``most`` bits.

    Keys are dealt by slice, so that every task sends the driver its own slices
    and all of them together have the filter's size.
    """
    n = keys.count()
    bits = bits_for(n)
    if bits > most:
        return None
    out = Bloom(bits)
    slices, each = out.slices, out.each

    def build(batches):
        held: dict[int, Bloom] = {}
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            s = (k >> np.uint64(40)).astype(np.int64) % slices
            for one in np.unique(s).tolist():
                held.setdefault(one, Bloom(each)).add(k[s == one])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.words.tobytes() for x in held.values()], pa.binary())], ["s", "w"])

    dealt = keys.select(F.col(column).cast("long").alias("k"))
    dealt = dealt.repartition(slices, F.pmod(F.shiftrightunsigned("k", 40), F.lit(slices))) if slices > 1 else dealt.coalesce(1)
    for r in dealt.mapInArrow(tidy(build), "s long, w binary").collect():  # bits / 8 bytes in all
        out.words[r["s"]] = np.frombuffer(r["w"], np.uint8)
    return out


def thinned(rows: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    """Of ``rows`` those whose long ``column`` may be in column ``name`` of ``keys``, thinned out before any exchange.

    By a broadcast filter as long as that is small; beyond, by a merge join, so
    that nothing broadcast grows with the data.
    """
    sieve = bloom_of(keys, name)
    if sieve is None:
        return rows.join(keys.select(F.col(name).alias(column)).distinct().hint("merge"), column, "left_semi").select(rows.columns)
    shared, at = rows.sparkSession.sparkContext.broadcast(sieve), rows.columns.index(column)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.has(b.column(at).to_numpy(zero_copy_only=False).view(np.uint64))))

    return rows.mapInArrow(tidy(run), rows.schema)
