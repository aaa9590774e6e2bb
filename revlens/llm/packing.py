"""Best-two-fit packing of tokenised documents into sequences.

Each document becomes its token ids and an end id. A document longer than a
sequence is cut into full pieces; its first piece holds the remainder. Every
other document stays whole. Pieces are packed by best-two-fit:

* a sequence is opened with the longest unpacked piece and filled greedily,
  always with the longest piece that still fits;
* if a gap is left, the sequence's smallest piece is taken out and two unpacked
  pieces are looked for whose lengths fill the widened gap better than it did,
  the tightest pair first; this repeats while it helps.

Packing runs inside each scan task over a pool of unpacked pieces that is
refilled as sequences are closed, so memory is bounded by the pool and a lost
task packs its own split again. Only when a split ends are pieces packed from a
shrinking pool; the sequences that stay underfilled then (less than ``FULL`` of
their length) are written apart and packed again together, in as many tasks as
they fill pools, so a table in many small parts loses no sequence per part. Only
their pieces are shuffled. Lengths present in the pool are one bit set, so finding
a fitting piece or pair is a few integer operations.

Defined results: a null or empty text is a document of the end id alone;
repeated rows are packed one by one; an empty table gives no rows; a null
doc_id is carried through. Sequence ids are unique but not consecutive.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, exact_ids, id_column, ids_of, release, safe_text, staged
from .tokens import encoder, runs, vocabulary_path

END_ID = 2
LENGTH = 1024
VOCABULARY = "byte_bpe_50k.json"
# Unpacked pieces kept at hand: sequences are closed above POOL_HIGH pieces
# until POOL_LOW are left.
POOL_HIGH, POOL_LOW = 6000, 4000
FULL = 0.98
SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
# Sequence ids of the second packing are above those of any scan task.
SECOND = 1 << 62


class _Rows:
    """Result rows of a task; sequences get consecutive ids from ``first``."""

    def __init__(self, first: int):
        self.sequence, self.rows = first, []

    def emit(self, found, tail: bool = False) -> None:
        at = 0
        for n, (doc, piece, start, ids) in found:
            self.rows.append((doc, piece, start, n, ids, self.sequence, at, tail))
            at += n
        self.sequence += 1

    def frame(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "tail"])
        out["doc_id"] = id_column([r[0] for r in self.rows])
        self.rows.clear()
        return out


class BestTwoFit:
    """Packer over items of length 1..capacity. ``add`` puts items into the
    pool; ``close`` yields finished sequences as lists of (length, item)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.stacks: dict[int, deque] = defaultdict(deque)
        self.present = 0  # bit n: an item of length n is unpacked
        self.mirror = 0  # bit capacity - n: the same, reversed
        self.size = 0

    def add(self, length: int, item) -> None:
        s = self.stacks[length]
        if not s:
            self.present |= 1 << length
            self.mirror |= 1 << (self.capacity - length)
        s.append(item)
        self.size += 1

    def _take(self, length: int):
        s = self.stacks[length]
        item = s.popleft()
        if not s:
            self.present &= ~(1 << length)
            self.mirror &= ~(1 << (self.capacity - length))
        self.size -= 1
        return length, item

    def _longest(self, room: int) -> int:
        """Longest unpacked length that fits, 0 if none does."""
        return max((self.present & ((1 << (room + 1)) - 1)).bit_length() - 1, 0)

    def _pair(self, total: int) -> int:
        """A length a such that a and total - a are unpacked, else 0."""
        both = self.present & (self.mirror >> (self.capacity - total)) if total <= self.capacity else 0
        if not total % 2 and len(self.stacks.get(total // 2, ())) < 2:
            both &= ~(1 << (total // 2))
        return max(both.bit_length() - 1, 0)

    def _fill(self) -> list:
        room, out = self.capacity, []
        while room and (n := self._longest(room)):
            out.append(self._take(n))
            room -= n
        while room and len(out) > 0:
            smallest = min(range(len(out)), key=lambda i: out[i][0])
            gap = room + out[smallest][0]
            a = 0
            for total in range(gap, out[smallest][0], -1):
                if a := self._pair(total):
                    break
            if not a:
                break
            back = out.pop(smallest)
            out += [self._take(a), self._take(total - a)]
            self.add(*back)
            room = gap - total
        return out

    def close(self, leave: int):
        while self.size > leave:
            yield self._fill()


def cut_points(n: int, length: int = LENGTH) -> list[int]:
    """Start offsets of a document's pieces: the first piece is the remainder."""
    first = n % length or min(n, length)
    return [0, *range(first, n, length)]


def _again(batches, length: int):
    """Packs the pieces of underfilled sequences anew."""
    ctx = TaskContext.get()
    out, pool = _Rows(SECOND + ((ctx.partitionId() if ctx else 0) << 33)), BestTwoFit(length)
    for pdf in batches:
        for doc, piece, start, n, ids in zip(ids_of(pdf), *(pdf[c].tolist() for c in ("piece", "start", "length", "ids"))):
            pool.add(n, (doc, piece, start, ids))
        if pool.size > POOL_HIGH:
            for found in pool.close(POOL_LOW):
                out.emit(found)
            yield out.frame().drop(columns="tail")
    for found in pool.close(0):
        out.emit(found)
    yield out.frame().drop(columns="tail")
    release()


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian
    unsigned 32-bit), sequence_id, offset. The first packing is written."""
    bound_batches(docs.sparkSession)
    path = vocabulary or vocabulary_path(VOCABULARY)

    def task(batches):
        enc = encoder(path, keep_space=True)
        ctx = TaskContext.get()
        out, pool = _Rows((ctx.partitionId() if ctx else 0) << 33), BestTwoFit(length)
        for pdf in batches:
            docs_, texts = ids_of(pdf), pdf["text"].tolist()
            for run in runs(texts):
                for i, ids in zip(run, enc.encode([texts[j] for j in run])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    blob, n = ids.tobytes(), len(ids)
                    starts = cut_points(n, length)
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                        item = (docs_[i], k, a, blob[4 * a:4 * b])
                        if b - a == length:
                            out.emit([(length, item)])
                        else:
                            pool.add(b - a, item)
                if pool.size > POOL_HIGH:
                    for found in pool.close(POOL_LOW):
                        out.emit(found)
                if out.rows:
                    yield out.frame()
        for found in pool.close(0):
            out.emit(found, sum(n for n, _ in found) < FULL * length)
        yield out.frame()
        release()

    first = staged(docs.select(*exact_ids(), safe_text().alias("text")).mapInPandas(task, SCHEMA + ", tail boolean"), "packing")
    tail = first.where("tail")
    tasks = max(1, tail.count() // POOL_HIGH)
    second = (tail.select(*exact_ids(), "piece", "start", "length", "ids")
              .repartition(tasks, F.xxhash64("ids", "doc_id")).sortWithinPartitions("doc_id", "piece", "start", "ids")
              .mapInPandas(lambda batches: _again(batches, length), SCHEMA))
    return first.where("not tail").drop("tail").unionByName(second)
