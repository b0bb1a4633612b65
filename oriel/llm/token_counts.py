"""Token counts of flat, unindexed token files.

A token file is a run of little-endian unsigned 16-bit ids in which an
end-of-document id closes each document; nothing tells where documents begin.
Files are cut into blocks of fixed size regardless of documents.  Each block is
searched for separators in one vectorised comparison; a two-level prefix scan
over block summaries (within segments of blocks, then over segments) stitches
the documents that cross blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import text_or_empty, tidy, written
from .bpe import encoded, encoder

#: Ids in a block, blocks in a segment of the prefix scan.
BLOCK, SEGMENT = 1 << 16, 1 << 10


def token_files(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 50256, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Encodes documents into one token file for each input partition.

    Returns the blocks (file, block, tokens) and the manifest (file, ordinal,
    key) that an indexed format would have; the scan reads the blocks only.
    Special tokens in texts are ordinary text here, so only ends are end ids.
    A vocabulary of more than 65,536 ids does not fit the format and is an error.
    """
    kind = docs.schema[key].dataType
    names = ["file", "block", "tokens", "first", "keys"]

    def run(batches):
        from pyspark import TaskContext

        file, held, n, done, ordinal, of = TaskContext.get().partitionId(), [], 0, 0, 0, None

        def row(k, tokens, first, keys):
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([k], pa.int64()), pa.array([tokens], pa.binary()), pa.array([first], pa.int64()), pa.array([keys], pa.list_(of))], names)

        enc = encoder(path, specials=False)
        if not end_id < 1 << 16 or max(enc.bytes_of) >= 1 << 16:
            raise ValueError("a token file holds 16-bit ids; the vocabulary has larger ones")
        for batch in batches:
            of = batch.schema.field(0).type
            yield row(None, None, ordinal, batch.column(0).to_pylist())
            ordinal += batch.num_rows
            for _, ids in encoded(enc, batch.column(1)):
                held.append(np.append(np.frombuffer(ids, "<u4"), end_id).astype("<u2"))
                n += len(held[-1])
                if n >= 8 * block or n >= 1 << 20:
                    flat = np.concatenate(held)
                    for at in range(0, n - n % block, block):
                        yield row(done, flat[at : at + block].tobytes(), None, None)
                        done += 1
                    held = [flat[n - n % block :]]
                    n %= block
        flat = np.concatenate(held) if held else np.zeros(0, "<u2")
        for at in range(0, n, block):
            yield row(done, flat[at : at + block].tobytes(), None, None)
            done += 1

    schema = T.StructType([T.StructField("file", T.LongType()), T.StructField("block", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("first", T.LongType()), T.StructField("keys", T.ArrayType(kind))])
    rows = written(docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(tidy(run), schema), "token-files")
    manifest = rows.where("keys is not null").select("file", "first", F.posexplode("keys").alias("i", "key")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "key")
    return rows.where("tokens is not null").select("file", "block", "tokens"), manifest


def document_lengths(blocks: DataFrame, end_id: int = 50256) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in blocks (file, block, tokens), end ids not counted.

    Tokens after a file's last separator are a document too; a file may hold
    blocks without any separator, empty documents and a single document.
    """

    def scan(batches):
        for b in batches:
            n, total, last, heads = [], [], [], []
            for raw in b.column(2).to_pylist():
                ids = np.frombuffer(raw, "<u2")
                at = np.flatnonzero(ids == end_id)
                n.append(len(at))
                total.append(len(ids))
                last.append(int(at[-1]) if len(at) else None)
                heads.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(total, pa.int64()), pa.array(last, pa.int64()), pa.array(heads, pa.list_(pa.int32()))], ["file", "block", "n", "total", "last", "ends"])

    seen = written(blocks.select("file", "block", "tokens").mapInArrow(tidy(scan), "file long, block long, n long, total long, last long, ends array<int>"), "block-ends")
    seen = seen.withColumn("segment", F.floor(F.col("block") / SEGMENT))
    # level 1: within a segment; positions count from the segment's start
    w = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = seen.withColumn("at", F.coalesce(F.sum("total").over(w), F.lit(0))).withColumn("docs", F.coalesce(F.sum("n").over(w), F.lit(0)))
    inner = inner.withColumn("open", F.max(F.col("at") + F.col("last")).over(w))
    # level 2: over segments
    tops = inner.groupBy("file", "segment").agg(F.sum("total").alias("s_total"), F.sum("n").alias("s_docs"), F.max(F.col("at") + F.col("last")).alias("s_last"))
    v = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("s_at", F.coalesce(F.sum("s_total").over(v), F.lit(0))).withColumn("s_before", F.coalesce(F.sum("s_docs").over(v), F.lit(0)))
    tops = tops.withColumn("s_open", F.max(F.col("s_at") + F.col("s_last")).over(v))
    joined = inner.join(tops.select("file", "segment", "s_at", "s_before", "s_open"), ["file", "segment"])
    start = F.col("s_at") + F.col("at")
    joined = joined.select("file", "ends", start.alias("start"), (F.col("s_before") + F.col("docs")).alias("ordinal"), F.coalesce(F.col("s_at") + F.col("open"), F.col("s_open"), F.lit(-1)).alias("open"))
    ends = joined.select("file", "ordinal", "start", "open", F.posexplode("ends").alias("i", "e"), "ends")
    before = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("start") + F.get("ends", F.col("i") - 1))
    closed = ends.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), (F.col("start") + F.col("e") - before - 1).alias("n_tokens"))
    tail = tops.groupBy("file").agg(F.sum("s_total").alias("t"), F.sum("s_docs").alias("ordinal"), F.coalesce(F.max(F.col("s_at") + F.col("s_last")), F.lit(-1)).alias("last"))
    tail = tail.select("file", "ordinal", (F.col("t") - F.col("last") - 1).alias("n_tokens")).where("n_tokens > 0")
    return closed.unionByName(tail)


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, block: int = BLOCK) -> DataFrame:
    """key and n_tokens of every document, by scanning the token files made of them.

    Null and empty texts count 0 tokens; repeated rows and null keys keep a row
    each; a text of any length is encoded whole and may fill many blocks.  Other
    columns are left out, whatever their names.  An empty table gives no rows.
    """
    blocks, manifest = token_files(docs, key, text, path, block=block)
    return manifest.join(document_lengths(blocks), ["file", "ordinal"]).select(F.col("key").alias(key), "n_tokens")
