"""Substring deduplication with repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document. Words covered by a
window whose word sequence also starts in a document with a smaller doc_id are
removed.

1. Documents are dealt into shards of consecutive doc_ids (about ``SHARD_CHARS``
   characters each), numbered in id order. A doc_id with so many rows that it
   fills several shards alone is spread over shards of one rank.
2. Every shard sends its distinct window hashes, sorted and cut into ranges, as
   one binary row per range. A range gets them from all shards and answers each
   shard with the hashes that a shard of lower rank has, too. A phrase that a
   third of all documents hold is one hash per shard.
3. A shard confirms its recurring passages: runs of windows found in lower
   shards, or first seen in the same smaller document of its own. They are
   compiled, as sequences of words, into the shard's Aho-Corasick automaton, and
   all documents of the shard stream through it; every occurrence in a document
   behind the passage's first one is removed.

An automaton holds only passages that occur in its own shard, so its size is
bounded by the shard, and none is broadcast. Windows are judged on the input,
never on what is left. Hashes are 64 bits wide; words are compared as they are.

Defined results: words are runs of other than ASCII white space; a null or empty
text has none; a null doc_id counts as larger than all others; rows that repeat a
doc_id are judged one by one, none is smaller than the other; texts with fewer
words than a window lose nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (_powers, bound_batches, exact_ids, id_column, ids_of, mix, release, safe_text, slices, staged, utf8,
                     word_hashes)

WINDOW = 13
SHARD_CHARS = 4_000_000
_U = np.uint64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
# The inverse of the multiplier of common._powers modulo 2**64.
_STEP = int(_powers(4)[1])
_BACK = pow(_STEP, -1, 1 << 64)


def _inverse_powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(n, _U(_BACK), _U)
        p[0] = 1
        return np.multiply.accumulate(p)


def window_hashes(texts: list[bytes], width: int) -> list[np.ndarray]:
    """64-bit hashes of the windows of each text, in order."""
    words: list[list[np.ndarray]] = [[] for _ in texts]
    for buf, spans in slices(texts):
        at, h = word_hashes(buf)
        lo = np.searchsorted(at, [s for _, s, _ in spans])
        hi = np.searchsorted(at, [e for _, _, e in spans])
        for (i, _, _), a, b in zip(spans, lo.tolist(), hi.tolist()):
            words[i].append(h[a:b])
    flat = np.concatenate([x for parts in words for x in parts] or [np.zeros(0, _U)])
    size = np.array([sum(map(len, parts)) for parts in words], np.int64)
    if len(flat) < width:
        return [flat[:0] for _ in texts]
    # Differences of one running sum, shifted back to the window's start.
    total = np.zeros(len(flat) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(flat * _powers(len(flat))[:len(flat)], out=total[1:])
        n = len(flat) - width + 1
        h = mix((total[width:] - total[:n]) * _inverse_powers(n))
    start = np.cumsum(size) - size
    return [h[a:a + max(k - width + 1, 0)] for a, k in zip(start.tolist(), size.tolist())]


def dealt(docs: DataFrame, shard_chars: int) -> tuple[DataFrame, int]:
    """(shard, rank, doc_id, no_id, text) and the number of shards."""
    spark = docs.sparkSession
    rows = docs.select(*exact_ids(), safe_text().alias("text"))
    total = rows.agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"),
                     F.sum(F.col("no_id").cast("long")).alias("nulls")).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["chars"] or 0) // shard_chars))
    # Borders of the id ranges: only they reach the driver, one per shard.
    found = rows.where("not no_id").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    borders, alone = [], {}
    for b in sorted(min(max(int(x), 1 - (1 << 63)), (1 << 63) - 1) for x in found):
        if borders and b == borders[-1]:
            alone[b] = alone.get(b, 1) + 1  # an id that fills a range by itself
        else:
            borders.append(b)
    # An id of that kind gets a range of its own.
    edges = np.array(sorted(set(borders) | {b - 1 for b in alone}), np.int64)
    spread = np.ones(len(edges) + 2, np.int64)
    for b, k in alone.items():
        spread[np.searchsorted(edges, b)] = k + 1
    spread[-1] = max(1, round(n * (total["nulls"] or 0) / max(total["n"], 1)))  # null ids: the last rank
    base = np.cumsum(spread) - spread

    @F.pandas_udf("struct<rank: int, base: int, spread: int>")
    def place(doc_id: pd.Series, no_id: pd.Series) -> pd.DataFrame:
        rank = np.where(no_id, len(edges) + 1, np.searchsorted(edges, doc_id.to_numpy()))
        return pd.DataFrame({"rank": rank.astype(np.int32), "base": base[rank].astype(np.int32), "spread": spread[rank].astype(np.int32)})

    rows = rows.withColumn("p", place("doc_id", "no_id"))
    rows = rows.select((F.col("p.base") + F.pmod(F.xxhash64("text"), F.col("p.spread"))).cast("int").alias("shard"),
                       F.col("p.rank").alias("rank"), "doc_id", "no_id", "text")
    return rows, int(spread.sum())


def _send(width: int, bits: int, batches):
    """Distinct window hashes of every shard, by range."""
    shard, rank, held = None, None, []

    def frame():
        h = np.unique(np.concatenate(held)) if held else np.zeros(0, _U)
        held.clear()
        part = (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(h) else np.zeros(0, np.int64)
        return pd.DataFrame({"part": part[at].astype(np.int32), "shard": np.int32(shard), "rank": np.int32(rank),
                             "hashes": [x.tobytes() for x in np.split(h, at[1:])] if len(at) else []})

    for pdf in batches:
        for s, r, some in ((s, r, g) for (s, r), g in pdf.groupby(["shard", "rank"], sort=True)):
            if s != shard:
                if shard is not None:
                    yield frame()
                shard, rank = s, r
            held += window_hashes(utf8(some["text"].tolist()), width)
            if len(held) > 4096:
                held[:] = [np.unique(np.concatenate(held))]
    if shard is not None:
        yield frame()
    release()


def _answer(batches):
    """Per range: to every shard its hashes that a shard of lower rank has."""
    part, shards, ranks, blobs = None, [], [], []

    def frame():
        sets = [np.frombuffer(b, _U) for b in blobs]
        rank = np.repeat(np.array(ranks), [len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.lexsort((rank, flat))
        f, r = flat[order], rank[order]
        first = np.append(True, f[1:] != f[:-1])
        lowest = r[np.flatnonzero(first)[np.cumsum(first) - 1]]
        again = np.empty(len(flat), bool)
        again[order] = r > lowest
        ends = np.cumsum([len(s) for s in sets])
        rows = [(s, x[a].tobytes()) for s, x, a in zip(shards, sets, np.split(again, ends[:-1])) if a.any()]
        for x in (shards, ranks, blobs):
            x.clear()
        return pd.DataFrame(rows, columns=["shard", "hashes"])

    for pdf in batches:
        for p, s, r, b in zip(pdf["part"], pdf["shard"], pdf["rank"], pdf["hashes"]):
            if p != part:
                if blobs:
                    yield frame()
                part = p
            shards.append(s)
            ranks.append(r)
            blobs.append(b)
    if blobs:
        yield frame()
    release()


def _runs(flags: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of maximal runs of flagged windows with the same first document."""
    if not flags.any():
        return []
    edge = np.append(True, (flags[1:] != flags[:-1]) | (first[1:] != first[:-1]))
    at = np.flatnonzero(edge)
    return [(a, b) for a, b in zip(at.tolist(), np.append(at[1:], len(flags)).tolist()) if flags[a]]


def _covered(size: int, spans) -> np.ndarray:
    step = np.zeros(size + 1, np.int64)
    for a, b in spans:
        step[a] += 1
        step[b] -= 1
    return np.cumsum(step)[:-1] > 0


def shard_spans(ids: list, texts: list[bytes], elsewhere: np.ndarray, width: int):
    """For every document of a shard (ids ascending, None last): its words and
    a mask of the removed ones. ``elsewhere``: sorted hashes of windows that
    documents of lower shards hold."""
    import ahocorasick

    hashes = window_hashes(texts, width)
    # Documents with equal ids are one in the order; nulls come last together.
    place = np.zeros(len(ids), np.int64)
    for k in range(1, len(ids)):
        place[k] = place[k - 1] + (ids[k] != ids[k - 1])
    flat = np.concatenate(hashes) if hashes else np.zeros(0, _U)
    doc = np.repeat(place, [len(h) for h in hashes])
    _, at, which = np.unique(flat, return_index=True, return_inverse=True)
    first = doc[at][which] if len(flat) else doc  # the first place of a hash is in its smallest document
    if len(elsewhere) and len(flat):
        k = np.minimum(np.searchsorted(elsewhere, flat), len(elsewhere) - 1)
        first = np.where(elsewhere[k] == flat, -1, first)
    again = first < doc
    ends = np.cumsum([len(h) for h in hashes])
    words = [_WORD.findall(t) for t in texts]
    number: dict[bytes, int] = {}
    coded = [tuple([number.setdefault(w, len(number)) for w in ws]) for ws in words]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for c, flags, source in zip(coded, np.split(again, ends[:-1]), np.split(first, ends[:-1])):
        for a, b in _runs(flags, source):
            passage = c[a:b + width - 1]
            known = automaton.get(passage, None)
            value = int(source[a])
            if known is None or value < known[1]:
                automaton.add_word(passage, (len(passage), value))
    if not len(automaton):
        return [(ws, np.zeros(len(ws), bool)) for ws in words]
    automaton.make_automaton()
    out = []
    for ws, c, p in zip(words, coded, place.tolist()):
        spans = [(end + 1 - n, end + 1) for end, (n, source) in automaton.iter(c) if source < p] if len(c) >= width else []
        out.append((ws, _covered(len(ws), spans)))
    return out


def _remove(width: int, batches):
    shard, known, ids, texts = None, [], [], []

    def frame():
        elsewhere = np.sort(np.concatenate(known)) if known else np.zeros(0, _U)
        rows = []
        for ws, gone in shard_spans(ids, texts, elsewhere, width):
            left = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            rows.append((len(ws), int(gone.sum()), left[::2].tolist(), left[1::2].tolist(),
                         b" ".join([w for w, x in zip(ws, gone.tolist()) if not x]).decode("utf-8", "surrogatepass")))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "starts", "stops", "kept"])
        out.insert(0, "doc_id", id_column(ids))
        for x in (known, ids, texts):
            x.clear()
        return out

    for pdf in batches:
        for s, h, doc, text in zip(pdf["shard"].tolist(), pdf["hashes"].tolist(), ids_of(pdf), pdf["text"].tolist()):
            if s != shard:
                if ids:
                    yield frame()
                shard = s
                known.clear()
            if h is not None:
                known.append(np.frombuffer(h, _U))
            else:
                ids.append(doc)
                texts.append(utf8([text])[0])
    if ids:
        yield frame()
    release()


def substring_dedup(docs: DataFrame, width: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, starts and stops of the
    removed stretches (words from 0, stop exclusive), kept (words left, joined by
    one space)."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows, shards = dealt(docs, shard_chars)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # As many hash ranges as shards: a range holds as many hashes as a shard.
    bits = max(shards - 1, 0).bit_length()
    sent = (rows.select("shard", "rank", "text").repartition(parts, "shard").sortWithinPartitions("shard")
            .mapInPandas(partial(_send, width, bits), "part int, shard int, rank int, hashes binary"))
    answers = staged(sent.repartition(parts, "part").sortWithinPartitions("part")
                     .mapInPandas(_answer, "shard int, hashes binary"), "repeated-windows")
    null = F.lit(None)
    both = (rows.select("shard", null.cast("binary").alias("hashes"), "doc_id", "no_id", "text")
            .unionByName(answers.select("shard", "hashes", F.lit(0).cast("long").alias("doc_id"), F.lit(False).alias("no_id"), F.lit("").alias("text"))))
    # A shard's answers come first, then its documents by id, nulls last.
    return (both.repartition(parts, "shard").sortWithinPartitions("shard", F.col("hashes").isNull(), "no_id", "doc_id")
            .mapInPandas(partial(_remove, width), "doc_id long, n_words long, n_removed long, starts array<int>, stops array<int>, kept string"))
