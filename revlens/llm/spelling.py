"""Spelling variant grouping: words one edit apart, by a sorted-list dynamic
programme.

Words are one edit apart when one code point is inserted, deleted or replaced.
A word's *form* is the most frequent word one edit away if that is at least
``RATIO`` times as frequent as the word itself; following forms leads to its
*root*.

1. ``vocabulary`` counts words (runs of letters, A-Z folded); one row per word
   and task reaches the exchange.
2. Words meet in blocks that agree outside a range of positions which holds the
   edit. The first blocks know the half it lies in; a block of more than
   ``BLOCK`` words is split at the middle of its range, down to one position,
   where a block holds at most one word per letter and one without it. So no
   block grows with the data and none is cut off.
3. Inside a block the words are sorted. Every word scans the words after it with
   a banded edit matrix (three cells per row): rows of the prefix that the next
   word shares with the last one (their LCP) are kept, only the others are
   computed; where a row has no cell of at most one edit, all words sharing that
   prefix are skipped. All words of a batch of blocks scan in step, in numpy.
   A pair is reported only in the block whose range holds the first place where
   the two differ, so it is found once.
4. Per word the blocks' counts and best neighbours are combined; roots follow by
   pointer doubling (a form is ``RATIO`` times as frequent, so chains are short).

Defined results: null and empty texts have no words; a null doc_id reads as the
empty text; repeated rows count again; ties between forms go to the smallest
word by code point; an empty table gives no rows; words may be of any length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, release, safe_text, small_side, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
RATIO = 10
BLOCK = 1024
# Cells (words times length) of the matrices of one batch of blocks.
CELLS = 1 << 20
MAX_ROUNDS = 40


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, noise: int | None = None) -> DataFrame:
    """(word, n) of the words of whole texts. With ``noise``, a run whose crc32
    of ``<doc_id>:<run>`` is a multiple of it loses one code point first."""
    bound_batches(docs.sparkSession)
    # Shorter runs can't give a word that is long enough.
    runs = (docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), safe_text().alias("text"))
            .select("id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS + "{%d,}" % least_length), F.lit(0))).alias("run")))
    word = F.col("run")
    if noise:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        runs = runs.withColumn("h", h).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
        shorter = F.expr("concat(substring(run, 1, at), substring(run, at + 2))")
        word = F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where((F.length("word") >= least_length) & (F.col("n") >= least_count)))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the part of a word outside the uncertain range lo..hi, given in
    positions of the longer word (of ``size`` code points) of a pair."""
    return rows.withColumn("key", F.expr("concat(substring(word, 1, lo), '\\0', substring(word, hi + 1 - (size - length(word))))"))


def _blocks(vocab: DataFrame, limit: int) -> DataFrame:
    """(size, lo, hi, key, word, n): every word in all blocks it belongs to."""
    both = F.expr("array(length(word), length(word) + 1)")
    rows = vocab.select("word", "n", F.explode(both).alias("size"))
    halves = F.expr("array(struct(0 AS lo, int(size / 2) AS hi), struct(int(size / 2) AS lo, size AS hi))")
    open_ = staged(_keyed(rows.select("word", "n", "size", F.inline(halves))), "spelling-blocks")
    at = ["size", "lo", "hi", "key"]
    done = None
    for k in range(MAX_ROUNDS):
        large = cut(open_.groupBy(at).count().where((F.col("count") > limit) & (F.col("hi") - F.col("lo") > 1)).select(at))
        if not large.limit(1).count():
            return open_ if done is None else done.unionByName(open_)
        side = small_side(large, 80)
        rest = open_.join(side, at, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        split = F.expr("array(struct(lo AS lo, int((lo + hi) / 2) AS hi), struct(int((lo + hi) / 2) AS lo, hi AS hi))")
        parts = open_.join(side, at, "left_semi").select("word", "n", "size", F.inline(split))
        open_ = staged(_keyed(parts), f"spelling-blocks-{k + 1}")
    raise RuntimeError("blocks did not become small")


def _codes(words: list[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def scan(words: list[str], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of words of the same block that are one edit apart.
    ``words`` are sorted inside each block; blocks are consecutive."""
    n = len(words)
    size = np.array([len(w) for w in words])
    width = int(size.max()) + 1
    code = _codes(words, width)
    index = np.arange(n)
    same = np.zeros(n, bool)
    same[1:] = block[1:] == block[:-1]
    # lcp[k]: shared prefix of word k and the word before it; -1 at a block's start.
    lcp = np.full(n + 1, -1)
    lcp[1:n][same[1:]] = np.logical_and.accumulate(code[1:] == code[:-1], axis=1)[same[1:]].sum(1)
    lcp[:n] = np.minimum(lcp[:n], size)
    # after[d][k]: the next word behind k that does not share d code points with it.
    breaks = [np.flatnonzero(lcp < d) for d in range(width)]
    # rows[q, i]: cells i-1, i, i+1 of row i, for query q against the prefix of
    # length i of the word it is at; at first that is q itself.
    rows = np.empty((n, width + 1, 3), np.int8)
    rows[:] = (1, 0, 1)
    rows[:, 0] = (2, 0, 1)
    at, q = index + 1, index
    found = []
    while True:
        keep = at < n
        keep[keep] = lcp[at[keep]] >= 0
        # a query leaves when its block ends
        q, at = q[keep], at[keep]
        if not len(q):
            break
        start, stop = lcp[at], size[at]
        dead = np.zeros(len(q), np.int64)  # depth at which a scan ended, 0: not at all
        for i in range(int(start.min()) + 1, int(stop.max()) + 1):
            on = np.flatnonzero((start < i) & (i <= stop) & (dead == 0))
            if not len(on):
                continue
            u, c = q[on], code[at[on], i - 1]
            old = rows[u, i - 1]
            left = old[:, 0] + (code[u, i - 2] != c) if i > 1 else old[:, 0]
            left = np.minimum(left, old[:, 1] + 1)
            mid = np.minimum(np.minimum(old[:, 1] + (code[u, i - 1] != c if i <= width else 1), old[:, 2] + 1), left + 1)
            right = np.minimum(old[:, 2] + (code[u, i] != c if i < width else 1), mid + 1)
            new = np.minimum(np.stack([left, mid, right], 1), 2).astype(np.int8)
            rows[u, i] = new
            dead[on[new.min(1) > 1]] = i
        alive = dead == 0
        diff = size[q] - size[at]
        ok = np.flatnonzero(alive & (np.abs(diff) <= 1))
        hit = ok[rows[q[ok], stop[ok], 1 + diff[ok]] == 1]
        found.append((q[hit], at[hit]))
        step = at + 1
        for d in np.unique(dead[~alive]):
            some = np.flatnonzero(dead == d)
            b = np.append(breaks[d], n)
            step[some] = b[np.searchsorted(b, at[some], "right")]
        at = step
    if not found:
        return index[:0], index[:0]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _first_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    return differ.argmax(1)


def _block_results(pdf: pd.DataFrame) -> pd.DataFrame | None:
    """Per word of some whole blocks: near words and the best of them."""
    words, n = pdf["word"].tolist(), pdf["n"].to_numpy()
    size, lo, hi = (pdf[c].to_numpy() for c in ("size", "lo", "hi"))
    a, b = scan(words, pdf["block"].to_numpy())
    if not len(a):
        return None
    length = np.array([len(w) for w in words])
    code = _codes(words, int(length.max()) + 1)
    place = _first_difference(code[a], code[b])
    # Only in the block of this longer length and of the range with the first difference.
    own = (np.maximum(length[a], length[b]) == size[a]) & (lo[a] <= place) & (place < hi[a])
    a, b = a[own], b[own]
    if not len(a):
        return None
    me, other = np.concatenate([a, b]), np.concatenate([b, a])
    text = np.array(words, object)
    order = sorted(range(len(me)), key=lambda k: (me[k], -n[other[k]], text[other[k]]))
    me, other = me[order], other[order]
    first = np.flatnonzero(np.append(True, me[1:] != me[:-1]))
    return pd.DataFrame({"word": text[me[first]], "n_near": np.diff(np.append(first, len(me))),
                         "best_n": n[other[first]], "best": text[other[first]]})


def _scan_blocks(batches):
    """Blocks arrive sorted; they are gathered up to CELLS and never divided."""
    held, cells = [], 0
    tail = None

    def flush():
        nonlocal cells
        pdf = pd.concat(held, ignore_index=True)
        held.clear()
        cells = 0
        return _block_results(pdf)

    number = 0
    for pdf in batches:
        if tail is not None:
            pdf = pd.concat([tail, pdf], ignore_index=True)
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), bool)
        for c in ("size", "lo", "hi", "key"):
            v = pdf[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        pdf["block"] = np.cumsum(change) + number
        number = int(pdf["block"].iloc[-1]) + 1
        last = pdf["block"] == pdf["block"].iloc[-1]
        tail = pdf[last].drop(columns="block")
        whole = pdf[~last]
        # Words alone in their block have no partner there.
        whole = whole[whole.groupby("block")["n"].transform("size") > 1]
        for size, part in whole.groupby("size", sort=True):
            ends = np.flatnonzero(np.append(np.diff(part["block"].to_numpy()) != 0, True)) + 1
            begin = 0
            for end in ends.tolist():
                if (end - begin) * (size + 1) >= CELLS or end == len(part):
                    held.append(part.iloc[begin:end])
                    cells += (end - begin) * (size + 1)
                    begin = end
                    if cells >= CELLS and (out := flush()) is not None:
                        yield out
    if tail is not None and len(tail) > 1:
        held.append(tail.assign(block=number))
    if held and (out := flush()) is not None:
        yield out
    release()


def near_words(vocab: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of words of ``vocab(word, n)`` (materialised)
    that have a word one edit away."""
    spark = vocab.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["size", "lo", "hi", "key"]
    found = (_blocks(vocab, limit).repartition(parts, *order).sortWithinPartitions(*order, "word")
             .mapInPandas(_scan_blocks, "word string, n_near long, best_n long, best string"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from materialised ``forms(word, form)``: every round doubles
    the steps followed."""
    now = forms.select("word", F.col("form").alias("root"))
    for k in range(MAX_ROUNDS):
        there = small_side(now.select(F.col("word").alias("root"), F.col("root").alias("further")), 80)
        ahead = staged(now.join(there, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                              F.col("further").isNotNull().alias("moved")), f"spelling-roots-{k}")
        now = ahead.select("word", "root")
        if not ahead.where("moved").limit(1).count():
            return now
    raise RuntimeError("forms did not end")


def group_variants(vocab: DataFrame, ratio: int = RATIO, limit: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``vocab(word, n)``."""
    vocab = staged(vocab, "spelling-vocabulary")
    near = near_words(vocab, limit)
    good = F.col("best_n") >= ratio * F.col("n")
    rows = staged(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = _roots(rows.where("form is not null").select("word", "form"))
    return rows.join(small_side(roots, 80), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
