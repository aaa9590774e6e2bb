"""Shared helpers of the training-data operators.

Conventions used by every operator of this subpackage:

* An operator selects the columns it names and ignores all others, so extra
  columns (also ones with the names of its own outputs) never clash.
* A null text counts as the empty text; a null ``doc_id`` is carried through.
* Texts reach Python in Arrow batches that are cut by rows and bytes; the
  helpers here never join more than ``SLICE_BYTES`` of text into one array
  unless a single word is longer.
"""

from __future__ import annotations

import re
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, staging_path

# Rows and bytes of one Arrow batch. Texts can be long: 10,000 rows (Spark's
# default) of long documents would sit in one Python worker at once.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
# Bytes of text that the numpy helpers look at together.
SLICE_BYTES = 1 << 20
# A join side is broadcast only when its counted rows stay under this size.
BROADCAST_BYTES = 16 << 20
# Module that holds what tasks cache in their Python worker (tokens.worker_cache).
WORKER_CACHE = "_llm_worker_cache"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Cut Arrow batches to BATCH_ROWS rows (never raising a smaller setting)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        spark.conf.set(key, str(BATCH_BYTES))
    except Exception:  # noqa: BLE001 -- not a setting of this Spark version
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared ``spark.checkpoint.dir`` and
    read it back: computed once, lineage cut, readable from every executor."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small intermediate table."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, row_bytes: int) -> bool:
    """Whether the counted rows of a materialised table fit BROADCAST_BYTES."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit BROADCAST_BYTES,
    else ``df`` as it is (the join then shuffles and AQE splits skewed keys).
    Call it on a materialised table: counting is a job of its own."""
    return F.broadcast(df) if fits(df, row_bytes) else df


def release() -> None:
    """Give freed memory back to the system at the end of a task: its Python
    worker stays, and later tasks of other operators share the executor."""
    import gc

    gc.collect()
    trim()


def trim() -> None:
    """:func:`release` for tasks that leave no reference cycles: takes about a
    millisecond, so that many small tasks can each end with it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


def make_room() -> None:
    """Drop what tasks of other operators cached in this Python worker (an
    encoder, say). For the start of a task that has no use for it: workers
    outlive their operator, and in a pipeline the next one runs in them."""
    if sys.modules.pop(WORKER_CACHE, None) is not None:
        release()


def safe_text(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def exact_ids(col: str = "doc_id") -> list:
    """An id as two columns without nulls: (col, no_id). pandas would turn a
    nullable long column into floats, which changes ids above 2**53 and how an
    id is written; :func:`ids_of` puts them together again."""
    i = F.col(col).cast("long")
    return [F.coalesce(i, F.lit(0)).alias(col), i.isNull().alias("no_id")]


def ids_of(pdf, col: str = "doc_id") -> list:
    """Python ints, None for null."""
    return [None if no else i for i, no in zip(pdf[col].tolist(), pdf["no_id"].tolist())]


def id_column(ids: list):
    """Exact nullable longs for a result column."""
    import pandas as pd

    none = np.array([i is None for i in ids], bool)
    return pd.arrays.IntegerArray(np.array([0 if i is None else i for i in ids], np.int64), none)


def held_out(col: str = "doc_id"):
    """Rows never used to fit: crc32 of the id as text, modulo 4, is 2. A null
    id has no remainder and counts as held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


# --------------------------------------------------------------------------
# numpy text helpers

_MULT = np.uint64(0x9E3779B97F4A7C15)
_pow = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers of an odd constant modulo 2**64 (at least ``n`` of them)."""
    global _pow
    if len(_pow) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 4096), np.uint64(0x100000001B3 * 2 + 0x8F1BBCDC | 1), np.uint64)
            p[0] = 1
            _pow = np.multiply.accumulate(p)
    return _pow


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift and multiply, as public mixers do)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def is_space(buf: np.ndarray) -> np.ndarray:
    """The six ASCII white-space bytes: 0x20 and 0x09 to 0x0D."""
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of every white-space separated word of a byte array."""
    ws = is_space(buf)
    word = ~ws
    first = word.copy()
    first[1:] &= ws[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    begin = starts[np.maximum(np.cumsum(first) - 1, 0)]
    pos = np.arange(len(buf)) - begin
    pos[ws] = 0
    with np.errstate(over="ignore"):
        vals = (buf.astype(np.uint64) + np.uint64(1)) * _powers(int(pos.max()) + 1)[pos]
        vals[ws] = 0
        return starts, mix(np.add.reduceat(vals, starts) * _MULT)


_CUT = re.compile(rb"[\x20\x09-\x0D]")


def slices(texts: list[bytes], size: int = SLICE_BYTES):
    """Group byte texts into runs of about ``size`` bytes. Yields
    ``(buffer, [(index, start, end), ...])``; texts are separated by a space.
    A longer text is cut at white space (so no word is split) and its parts
    come in order, each in a buffer of its own."""
    run, spans, at = [], [], 0
    for i, t in enumerate(texts):
        if len(t) > size:
            if run:
                yield np.frombuffer(b" ".join(run) + b" ", np.uint8), spans
                run, spans, at = [], [], 0
            s = 0
            while s < len(t):
                e = len(t)
                if e - s > size and (m := _CUT.search(t, s + size)):
                    e = m.end()
                yield np.frombuffer(t[s:e] + b" ", np.uint8), [(i, 0, e - s)]
                s = e
            continue
        if at + len(t) > size and run:
            yield np.frombuffer(b" ".join(run) + b" ", np.uint8), spans
            run, spans, at = [], [], 0
        run.append(t)
        spans.append((i, at, at + len(t)))
        at += len(t) + 1
    if run:
        yield np.frombuffer(b" ".join(run) + b" ", np.uint8), spans


def utf8(texts) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
