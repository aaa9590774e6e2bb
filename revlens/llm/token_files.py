"""Token-id files in patched frame-of-reference blocks.

Documents are range-partitioned and sorted by doc_id, tokenised, and written as
segments. A segment is one self-contained binary value:

    b"PFB1", number of ids and of blocks (unsigned 32-bit, little endian),
    block index: byte offset of every block in the segment (u32 each),
    blocks of up to 128 ids: minimum (u32), count (u8), bit width (u8),
    number of exceptions (u8), packed low bits of id - minimum, then the
    exceptions' positions (u8 each) and their high bits (u32 each).

The bit width of a block is chosen so that a ``PERCENTILE`` share of its
differences fits; what is larger keeps its low bits in place and its high bits
in the exception list. The index lets a reader decode any block alone.

Segments are rows of a Parquet folder (shard, segment, doc_ids, no_ids, sizes, blob;
a null id is 0 with no_id set):
Spark's writers commit them on any store, and a lost task writes its shard
again. Only per-shard totals (one row per shard) are gathered to number ids
across shards.

Defined results: a null or empty text is a document of the end id alone;
repeated doc_ids keep a place each (in an order by their texts' hashes, so that
the rows of one id can fill several shards);
null ids come first; an empty table gives no rows; a segment holds whole
documents, so a document longer than ``SEGMENT_IDS`` makes a longer segment.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staging_path
from .common import bound_batches, cut, exact_ids, id_column, release, safe_text, small_side
from .tokens import encoder, runs, vocabulary_path

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
BLOCK = 128
PERCENTILE = 0.95
SEGMENT_IDS = 1 << 17
MAGIC = b"PFB1"
FILE_SCHEMA = "shard int, segment int, doc_ids array<bigint>, no_ids array<boolean>, sizes array<int>, total long, blob binary"


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) + 1, 0)


def _pack_bits(low: np.ndarray, width: int) -> np.ndarray:
    """(k, BLOCK) values below 2**width to (k, BLOCK * width / 8) bytes."""
    if width == 16:
        return low.astype("<u2").view(np.uint8).reshape(len(low), -1)
    bits = np.unpackbits(low.astype("<u4").view(np.uint8).reshape(len(low), BLOCK, 4), axis=2, bitorder="little")
    return np.packbits(bits[:, :, :width].reshape(len(low), -1), axis=1, bitorder="little")


def _unpack_bits(raw: np.ndarray, width: int) -> np.ndarray:
    if width == 16:
        return np.ascontiguousarray(raw).view("<u2").astype(np.uint32)
    if not width:
        return np.zeros((len(raw), BLOCK), np.uint32)
    bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(raw), BLOCK, width)
    full = np.zeros((len(raw), BLOCK, 32), np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full, axis=2, bitorder="little").view("<u4").reshape(len(raw), BLOCK)


def encode_segment(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One segment of at least one id."""
    n = len(ids)
    k = -(-n // BLOCK)
    block = np.full(k * BLOCK, ids[-1], np.int64)
    block[:n] = ids
    block = block.reshape(k, BLOCK)
    low = block.min(1)
    diff = block - low[:, None]
    rank = min(int(np.ceil(percentile * BLOCK)), BLOCK) - 1
    width = _bit_length(np.partition(diff, rank, axis=1)[:, rank])
    over = diff >> width[:, None] > 0
    n_over = over.sum(1)
    size = 7 + BLOCK // 8 * width + 5 * n_over
    start = 12 + 4 * k + np.cumsum(size) - size
    out = np.zeros(int(12 + 4 * k + size.sum()), np.uint8)
    out[:12] = np.frombuffer(MAGIC + np.array([n, k], "<u4").tobytes(), np.uint8)
    out[12:12 + 4 * k] = start.astype("<u4").view(np.uint8)
    count = np.full(k, BLOCK)
    count[-1] = n - (k - 1) * BLOCK
    head = np.zeros((k, 7), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(k, 4)
    head[:, 4], head[:, 5], head[:, 6] = count, width, n_over
    out[start[:, None] + np.arange(7)] = head
    for w in np.unique(width):
        if w:
            b = np.flatnonzero(width == w)
            packed = _pack_bits(diff[b] & ((1 << int(w)) - 1), int(w))
            out[(start[b] + 7)[:, None] + np.arange(packed.shape[1])] = packed
    row, col = np.nonzero(over)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(n_over) - n_over)[row]
        at = start + 7 + BLOCK // 8 * width
        out[at[row] + nth] = col
        high = (diff[row, col] >> width[row]).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(at[row] + n_over[row] + 4 * nth)[:, None] + np.arange(4)] = high
    return out.tobytes()


def decode_segment(blob: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks first..last-1 (all by default), located by the index."""
    if blob[:4] != MAGIC:
        raise ValueError("not a segment")
    raw = np.frombuffer(blob, np.uint8)
    n, k = np.frombuffer(blob, "<u4", 2, 4).tolist()
    start = np.frombuffer(blob, "<u4", k, 12).astype(np.int64)[first:last]
    if not len(start):
        return np.zeros(0, np.uint32)
    head = raw[start[:, None] + np.arange(7)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4").ravel().astype(np.int64)
    count, width, n_over = (head[:, c].astype(np.int64) for c in (4, 5, 6))
    diff = np.zeros((len(start), BLOCK), np.int64)
    for w in np.unique(width):
        b = np.flatnonzero(width == w)
        if w:
            diff[b] = _unpack_bits(raw[(start[b] + 7)[:, None] + np.arange(BLOCK // 8 * w)], int(w))
    row = np.repeat(np.arange(len(start)), n_over)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(n_over) - n_over)[row]
        at = start + 7 + BLOCK // 8 * width
        col = raw[at[row] + nth]
        high = np.ascontiguousarray(raw[(at[row] + n_over[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
        diff[row, col] += high.astype(np.int64) << width[row]
    ids = (diff + low[:, None]).astype(np.uint32)
    if (count == BLOCK).all():
        return ids.ravel()
    return ids[np.arange(BLOCK) < count[:, None]]


def write(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = END_ID,
          partitions: int | None = None) -> str:
    """Tokenise, sort by doc_id and write; returns the folder. One shard per
    partition; shards are in id order."""
    spark = docs.sparkSession
    bound_batches(spark)
    path = path or staging_path(spark, "token-files")
    vocab = vocabulary or vocabulary_path(VOCABULARY)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def task(batches):
        enc = encoder(vocab, keep_space=False)
        ctx = TaskContext.get()
        shard, segment = ctx.partitionId() if ctx else 0, 0
        ids, doc_ids, no_ids, sizes, held = [], [], [], [], 0
        cols = ["shard", "segment", "doc_ids", "no_ids", "sizes", "total", "blob"]

        def flush():
            nonlocal held, segment
            flat = np.concatenate(ids)
            row = (shard, segment, list(doc_ids), list(no_ids), list(sizes), held, encode_segment(flat))
            segment += 1
            held = 0
            for x in (ids, doc_ids, no_ids, sizes):
                x.clear()
            return row

        for pdf in batches:
            docs_, without, texts, rows = pdf["doc_id"].tolist(), pdf["no_id"].tolist(), pdf["text"].tolist(), []
            for run in runs(texts):
                for i, got in zip(run, enc.encode([texts[j] for j in run])):
                    got = np.append(got, np.uint32(end_id))
                    ids.append(got)
                    doc_ids.append(docs_[i])
                    no_ids.append(without[i])
                    sizes.append(len(got))
                    held += len(got)
                    if held >= SEGMENT_IDS:
                        rows.append(flush())
            if rows:
                yield pd.DataFrame(rows, columns=cols)
        if ids:
            yield pd.DataFrame([flush()], columns=cols)
        release()

    order = [F.col("no_id").desc(), "doc_id", "hash", "text"]  # null ids first
    (docs.select(*exact_ids(), safe_text().alias("text")).withColumn("hash", F.xxhash64("text"))
     .repartitionByRange(n, *order[:3]).sortWithinPartitions(*order).select("doc_id", "no_id", "text")
     .mapInPandas(task, FILE_SCHEMA).write.parquet(path))
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder: doc_id, start (ids of all documents before),
    n_tokens, ids (little-endian unsigned 32-bit)."""
    bound_batches(spark)
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One row per shard; the running sum over shards is bounded by their number.
    shards = cut(files.groupBy("shard").agg(F.sum("total").alias("ids")))
    before = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    within = Window.partitionBy("shard").orderBy("segment")
    place = cut(files.select("shard", "segment", "total")
                .withColumn("inside", F.sum("total").over(within) - F.col("total"))
                .join(F.broadcast(before), "shard").select("shard", "segment", (F.col("base") + F.col("inside")).alias("base")))
    placed = files.join(small_side(place, 48), ["shard", "segment"])

    def task(batches):
        for pdf in batches:
            for base, docs_, without, sizes, blob in zip(pdf["base"], pdf["doc_ids"], pdf["no_ids"], pdf["sizes"], pdf["blob"]):
                flat = decode_segment(blob).astype("<u4").tobytes()
                n = np.asarray(sizes, np.int64)
                end = np.cumsum(n)
                yield pd.DataFrame({
                    "doc_id": id_column([None if no else int(d) for d, no in zip(docs_, without)]),
                    "start": int(base) + end - n, "n_tokens": n,
                    "ids": [flat[4 * a:4 * b] for a, b in zip((end - n).tolist(), end.tolist())]})

    return placed.select("base", "doc_ids", "no_ids", "sizes", "blob").mapInPandas(
        task, "doc_id bigint, start long, n_tokens long, ids binary")
