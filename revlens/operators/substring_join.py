"""Substring matching with a keyword table (JON-2 for lexicons that are data).

Texts are scanned for places where a keyword may stand, by the hash of the place's
first code points for every length that a keyword has. The sum of all code points
times the powers of an odd number, kept for every prefix of a stretch of text, gives
the hash of any place in it by one subtraction and one product. A place is looked up
in a table of ``SLOTS`` slots by its first ``Q`` code points, which says what lengths
of keywords begin so, and then by its whole length in a bit filter of all keywords.
What passes comes out once a text, as a string, and meets the lexicon in an equi-join
on the keyword, so that the filter's errors drop out. Candidates are thus as many as
matches but for the filter's rare errors, however many keywords share a run.

What tasks hold does not grow with the lexicon beyond ``MOST_BITS`` bits of filter.
The lexicon is broadcast when its counted size allows it, else both sides are
shuffled by (keyword, salt). A text's matches leave its task once; only texts whose
keys repeat go through a distinct.

NULL texts and empty keywords match nothing; rows that repeat their keys are one text;
lexicon rows that repeat are one row. Keywords found in a text are told apart by
64-bit hashes, those of more than ``LONG`` code points by Python's own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..session import bound_batches, materialize
from . import spam

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Q = 6
SLOTS = 1 << 20
# Bits of the filter for each keyword, and at most.
KEYWORD_BITS = 64
MOST_BITS = 1 << 28
LONG = 64
SALTS = 16
PIECE = 1 << 18        # code points that are hashed together
ODD, MIX, AGAIN = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _powers(odd: int, n: int) -> np.ndarray:
    out = np.full(n, odd, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Hashes of any places of a stretch of text."""

    def __init__(self, text: str):
        x = (np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
        x ^= x >> np.uint64(29)
        power, self.back = _powers(ODD, len(x)), _powers(pow(ODD, -1, 1 << 64), len(x))
        self.upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power, dtype=np.uint64)])

    def of(self, at: np.ndarray | slice, length) -> np.ndarray:
        """Of the places ``at`` of ``length`` code points; the length counts too."""
        end = slice(at.start + length, at.stop + length) if isinstance(at, slice) else at + length
        h = (self.upto[end] - self.upto[at]) * self.back[at] + np.asarray(length).astype(np.uint64) * np.uint64(AGAIN)
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        return h ^ (h >> np.uint64(29))


def _top(h: np.ndarray, size: int, odd: int) -> np.ndarray:
    return ((h * np.uint64(odd)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _stretches(texts: list[str], reach: int | None = None) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and texts that are hashed together, PIECE code points or one text;
    with ``reach`` a longer one comes in pieces that overlap by so much."""
    at, held, size = [], [], 0
    for i, t in enumerate(texts):
        if at and size + len(t) > PIECE:
            yield at, held
            at, held, size = [], [], 0
        if reach is not None and len(t) > PIECE:
            for s in range(0, len(t), PIECE):
                yield [i], [t[s:s + PIECE + reach]]
        elif t:
            at.append(i)
            held.append(t)
            size += len(t)
    if at:
        yield at, held


def _once(keys: np.ndarray) -> np.ndarray:
    """Places of one element of every value."""
    out, rest, table = [], np.arange(len(keys)), np.empty(1 << 16, np.int64)
    while len(rest):
        slot = _top(keys[rest], len(table), AGAIN)
        table[slot] = rest
        won = table[slot]
        out.append(rest[won == rest])
        rest = rest[keys[won] != keys[rest]]
    return np.concatenate(out) if out else rest


class Filter:
    """What every task knows of the lexicon."""

    def __init__(self, lengths: list[int], keywords: int):
        self.short = [n for n in lengths if n < Q]
        self.long = [n for n in lengths if n >= Q]
        self.reach = max(lengths, default=1) - 1
        self.bits = min(MOST_BITS, max(1 << 16, 1 << (KEYWORD_BITS * keywords - 1).bit_length()))

    def rows(self, batches, column: int):
        """(kind, word, bits) of the lexicon's keywords: kind 0 the filter, kind 1 the slots."""
        kinds = {n: i % 64 for i, n in enumerate(self.long)}
        for batch in batches:
            for _, held in _stretches(batch.column(column).to_pylist()):
                n = np.array([len(t) for t in held])
                at = np.cumsum(n) - n
                h, begin = Hashes("".join(held)), n >= Q
                whole, first = h.of(at, n), h.of(at[begin], Q)
                place = np.concatenate([_top(whole, self.bits, ODD), _top(whole, self.bits, AGAIN)])
                kind = np.array([kinds[k] for k in n[begin].tolist()], np.uint64)
                bits = np.concatenate([np.uint64(1) << (place % 64).astype(np.uint64), np.uint64(1) << kind]).view(np.int64)
                word = np.concatenate([place // 64, _top(first, SLOTS, ODD)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([0, 1], [len(place), len(kind)]), pa.int32()), pa.array(word, pa.int32()), pa.array(bits, pa.int64())],
                    ["kind", "word", "bits"])

    def fill(self, rows: pa.Table) -> None:
        self.words, self.slots = np.zeros(self.bits // 64, np.uint64), np.zeros(SLOTS, np.uint64)
        kind, word, bits = (c.to_numpy() for c in rows.columns)
        for k, into in enumerate((self.words, self.slots)):
            into[word[kind == k]] = bits[kind == k].view(np.uint64)

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes that the filter holds."""
        octets = self.words.astype("<u8", copy=False).view(np.uint8)

        def held(p):
            return np.flatnonzero((octets[p >> 3] >> (p & 7).astype(np.uint8)) & 1)

        ok = held(_top(h, self.bits, ODD))
        return ok[held(_top(h[ok], self.bits, AGAIN))]

    def places(self, h: Hashes, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, hashes) where a keyword may stand; ``left`` are the code
        points from a place to its text's end."""
        n = len(left)
        for m in self.short:
            whole = h.of(slice(0, max(n - m + 1, 0)), m)
            at = self.passes(whole)
            at = at[left[at] >= m]
            yield m, at, whole[at]
        if not self.long:
            return
        slots = self.slots[_top(h.of(slice(0, max(n - Q + 1, 0)), Q), SLOTS, ODD)]
        some = np.flatnonzero(slots)
        slots = slots[some]
        for i in range(min(len(self.long), 64)):
            of_kind = some[np.flatnonzero(slots & np.uint64(1 << i))]
            for m in self.long[i::64]:
                at = of_kind[left[of_kind] >= m]
                whole = h.of(at, m)
                ok = self.passes(whole)
                yield m, at[ok], whole[ok]

    def found(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Of texts hashed together: a text's number and a candidate's number, each
        pair once, and the candidates."""
        joined, n = "".join(texts), np.array([len(t) for t in texts])
        ends = np.cumsum(n)
        owner = np.repeat(np.arange(len(n)), n)
        left = ends[owner] - np.arange(len(owner))
        h, at, size, key = Hashes(joined), [], [], []
        for m, p, whole in self.places(h, left):
            if m > LONG:
                whole = np.array([hash(joined[s:s + m]) for s in p.tolist()], np.int64).view(np.uint64)
            one = _once(whole ^ (owner[p].astype(np.uint64) * np.uint64(MIX)))
            at.append(p[one])
            size.append(np.full(len(one), m))
            key.append(whole[one])
        if not at:
            return np.zeros(0, np.int64), [], np.zeros(0, np.int64)
        at, size = np.concatenate(at), np.concatenate(size)
        _, first, number = np.unique(np.concatenate(key), return_index=True, return_inverse=True)
        return owner[at], [joined[p:p + m] for p, m in zip(at[first].tolist(), size[first].tolist())], number


def index(table: DataFrame) -> Filter:
    """The filter of a materialised lexicon's ``_low``. To the driver come its lengths
    and at most MOST_BITS bits and SLOTS slots, of fixed width."""
    lengths = sorted(r[0] for r in table.select(F.length("_low")).distinct().collect())
    made = Filter(lengths, table.count())
    rows = table.select("_low").mapInArrow(lambda batches: made.rows(batches, 0), "kind int, word int, bits long")
    found = rows.groupBy("kind", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    made.fill(found)
    return made


def _scan(low: DataFrame, keys: list[str], lexicon: Filter) -> DataFrame:
    """``keys`` and a candidate (``_low``), each once a row of ``low``."""
    def scan(batches):
        for batch in batches:
            texts, seen, of = batch.column(len(keys)).to_pylist(), set(), -1
            for at, held in _stretches(texts, lexicon.reach):
                owner, words, number = lexicon.found(held)
                if len(texts[at[0]]) > PIECE:  # one of a text's pieces
                    seen, of = (seen if of == at[0] else set()), at[0]
                    words = [w for w in words if w not in seen]
                    seen.update(words)
                    owner, number = np.zeros(len(words), np.int64), np.arange(len(words))
                rows = pa.array(np.array(at)[owner], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(rows) for j in range(len(keys))), pa.array(words, pa.string()).take(pa.array(number, pa.int64()))],
                                                 [*keys, "_low"])

    return low.mapInArrow(scan, S.StructType([*low.select(*keys).schema.fields, S.StructField("_low", S.StringType())]))


def match(texts: DataFrame, lexicon: DataFrame, text_col: str = "reviews", keys: tuple[str, ...] = ("review_id",), keyword: str = "keyword") -> DataFrame:
    """One row per text and lexicon row whose keyword occurs anywhere in the text,
    upper and lower case alike: ``keys`` and the lexicon's columns."""
    keys = list(keys)
    bound_batches(texts.sparkSession)
    if set(keys) & set(lexicon.columns):
        raise ValueError("keys and lexicon columns must have different names")
    low = texts.where(F.col(text_col).isNotNull()).select(*keys, T.lower(text_col).alias("_text"))
    table = materialize(lexicon.distinct().withColumn("_low", T.lower(keyword)).where("_low <> ''"))
    made = index(table)
    _, _, small = spam._broadcast_if_small(table, "_low")

    def matches(rows):
        found = _scan(rows, keys, made)
        if small:
            pairs = found.join(F.broadcast(table), "_low")
        else:
            salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            pairs = found.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")).join(salted, ["_low", "_salt"])
        return pairs.select(*keys, *lexicon.columns)

    again = materialize(low.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(*[F.col(k).alias(f"_again_{k}") for k in keys]))
    few = again.limit(spam.MAX_IN_LIST + 1).count()
    if not few:
        return matches(low)
    other = F.broadcast(again) if few <= spam.MAX_IN_LIST else again
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_again_{k}")) for k in keys])
    return matches(low.join(other, same, "left_anti")).unionByName(matches(low.join(other, same, "left_semi")).distinct())
