"""Near-duplicate detection with HyperMinHash.

A document's set is its distinct word shingles (``Rule``: five words and a
similarity of 0.8 unless told otherwise; words are split at ASCII white space,
A-Z folded to a-z). Sketch: every shingle hash falls into one of ``REGISTERS``
buckets; a bucket keeps, of its smallest hash, the number of leading zeros
(6 bits) and the next ``MANTISSA`` bits. Empty buckets of short documents copy a
full one chosen by a fixed random order, so a register of two documents agrees
with probability equal to their Jaccard similarity (plus the known chance of
equal compressed registers).

1. Documents with equal sets are one class; its smallest doc_id stands for it.
2. ``Rule.band`` registers at a time are hashed to a band key. Classes that share
   a key are linked to the smallest class of that key; connected components of
   these links contain every candidate pair, and no pair is listed.
3. Inside each such group links are confirmed on the full shingle sets, with
   100 * intersection >= percent * union, in the order of the registers' collision-
   corrected estimates: the likeliest pairs come first, and a pair whose ends are
   connected by then needs no look. No pair is left out for its estimate. Groups of
   more than ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles are split over tasks: each block compares its own members and all members with
   a few pivots; classes that are not connected to the group's largest
   component after that are compared with every block, using what distinguishes
   each set from the first pivot instead of the whole set (the intersection
   follows exactly from those differences). That last step is quadratic in the
   loose classes of one group, in blocks over all tasks; nothing is capped.
4. Connected components of the confirmed links are the result.

The bands miss a pair at the threshold itself with a probability below 1e-6
(25 bands of 5 registers at 0.85, 32 bands of 4 registers at 0.8).

Defined results: null and empty texts and texts without words have an empty set
and link with nothing; fewer words than a shingle has are one shingle; rows with
a null doc_id take no part (component_id null, kept); rows that repeat a doc_id are
one document, and all of its texts are in its component; ``drop_near_copies`` drops
texts, so there a text stays unless another text like it does; an empty table
gives no rows; texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (bound_batches, cut, exact_ids, id_column, ids_of, make_room, mix, release, safe_text, slices, small_side, staged, trim, utf8,
                     word_hashes)
from .components import components

@dataclass(frozen=True)
class Rule:
    """Words of a shingle, least similarity in per cent, registers of a band."""

    shingle: int = 5
    percent: int = 80
    band: int = 4

    @property
    def bands(self) -> int:
        return REGISTERS // self.band


REGISTER_BITS = 7
REGISTERS = 1 << REGISTER_BITS
MANTISSA = 10
# Chance that two registers with different minima are stored alike, for the
# estimate; with 10 mantissa bits it is small whatever the set sizes.
COLLISION = 0.17 / (1 << MANTISSA) * 6
BLOCK = 1024
# Shingles (8 bytes each) of one block.
BLOCK_SHINGLES = 2 << 20
# Bytes of text that shingling looks at together; a worker needs some 40 times it.
SET_BYTES = 1 << 18
PIVOTS = 4
_U = np.uint64


# --------------------------------------------------------------------------
# Sketches

def _lower(t: bytes) -> bytes:
    return t.translate(_LOWER)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_sets(texts, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    for buf, spans in slices([_lower(t) for t in utf8(texts)], SET_BYTES):
        at, h = word_hashes(buf)
        lo = np.searchsorted(at, [s for _, s, _ in spans])
        hi = np.searchsorted(at, [e for _, _, e in spans])
        for (i, _, _), a, b in zip(spans, lo.tolist(), hi.tolist()):
            words[i].append(h[a:b])
    out = []
    with np.errstate(over="ignore"):
        for parts in words:
            w = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, _U)
            if not len(w):
                out.append(w)
                continue
            # A shingle's hash folds its words in order; a shorter text is folded whole.
            n = min(width, len(w))
            s = w[:len(w) - n + 1] + _U(n)
            for k in range(1, n):
                s = mix(s * _U(0x9E3779B97F4A7C15) + w[k:len(w) - n + 1 + k])
            s = np.sort(mix(s))
            out.append(s[np.append(True, s[1:] != s[:-1])])
    return out


def _probe_order() -> np.ndarray:
    rng = np.random.default_rng(2024)
    return np.array([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


_PROBE = _probe_order()


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a sorted, non-empty hash set."""
    bucket = (s >> _U(64 - REGISTER_BITS)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    full = bucket[first]
    rest = (s[first] << _U(REGISTER_BITS)) | _U((1 << REGISTER_BITS) - 1)  # never zero
    # Leading zeros from the position of the highest one bit.
    top = np.frexp((rest >> _U(11)).astype(np.float64))[1] + 10
    zeros = np.minimum(63 - top, 62).astype(np.uint64)
    mantissa = ((rest << zeros) << _U(1)) >> _U(64 - MANTISSA)
    regs = np.zeros(REGISTERS, np.uint16)
    regs[full] = ((zeros << _U(MANTISSA)) | mantissa).astype(np.uint16)
    if len(full) < REGISTERS:
        has = np.zeros(REGISTERS, bool)
        has[full] = True
        empty = np.flatnonzero(~has)
        order = _PROBE[empty]
        regs[empty] = regs[order[np.arange(len(empty)), has[order].argmax(1)]]
    return regs


def band_keys(regs: np.ndarray, band: int) -> np.ndarray:
    """One 64-bit key per band of (n, REGISTERS) registers."""
    bands = REGISTERS // band
    h = np.zeros((len(regs), bands), _U)
    with np.errstate(over="ignore"):
        r = regs[:, :bands * band].reshape(len(regs), bands, band).astype(_U)
        for k in range(band):
            h = mix(h + r[:, :, k] + _U(k + 1))
        return mix(h + np.arange(bands, dtype=_U))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of all pairs of rows of registers."""
    out = np.empty((len(a), len(b)), np.float32)
    for i, row in enumerate(a):
        out[i] = (row == b).mean(1)
    return (out - COLLISION) / (1 - COLLISION)


def sketch(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n (set size), h1, h2 (hash of the set), bands."""
    bound_batches(docs.sparkSession)

    def task(batches):
        make_room()
        for pdf in batches:
            sets = shingle_sets(list(pdf["text"]), rule.shingle)
            regs = np.array([registers(s) for s in sets if len(s)], np.uint16).reshape(-1, REGISTERS)
            keys = iter(band_keys(regs, rule.band).view(np.int64))
            with np.errstate(over="ignore"):
                h1 = [int(s.sum(dtype=_U).view(np.int64)) if len(s) else 0 for s in sets]
                h2 = [int(np.bitwise_xor.reduce(mix(s ^ _U(0xA5A5A5A5A5A5A5A5))).view(np.int64)) if len(s) else 0 for s in sets]
            yield pd.DataFrame({"doc_id": id_column(ids_of(pdf)), "n": np.array([len(s) for s in sets], np.int64),
                                "h1": h1, "h2": h2, "bands": [next(keys) if len(s) else None for s in sets]})
        release()

    return docs.select(*exact_ids(), safe_text().alias("text")).mapInPandas(
        task, "doc_id long, n long, h1 long, h2 long, bands array<bigint>")


def candidate_sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """Shingle sets and registers of the wanted documents: (grp, blocks, degree,
    rep, n, shingles, regs). ``wanted(doc_id, grp, blocks, degree)`` is materialised."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), safe_text().alias("text")).join(small_side(wanted, 64), "doc_id")

    def task(batches):
        make_room()
        for pdf in batches:
            sets = shingle_sets(list(pdf["text"]), rule.shingle)
            pdf = pdf.drop(columns="text")
            pdf["n"] = [len(s) for s in sets]
            pdf["shingles"] = [s.tobytes() for s in sets]
            pdf["regs"] = [registers(s).tobytes() if len(s) else b"" for s in sets]
            yield pdf[["grp", "blocks", "degree", "doc_id", "n", "shingles", "regs"]].rename(columns={"doc_id": "rep"})
        release()

    return texts.select("grp", "blocks", "degree", "doc_id", "text").mapInPandas(
        task, "grp long, blocks int, degree long, rep long, n long, shingles binary, regs binary")


# --------------------------------------------------------------------------
# Confirmation

class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def near(inter, size_a, size_b, percent: int):
    return 100 * inter >= percent * (size_a + size_b - inter)


def _matrix(sets: list[np.ndarray], vocab: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """0/1 rows of sets over vocab[lo:hi] (sorted)."""
    m = np.zeros((len(sets), hi - lo), np.float32)
    part = vocab[lo:hi]
    for i, s in enumerate(sets):
        s = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], "right")]
        if len(s):
            at = np.minimum(np.searchsorted(part, s), len(part) - 1)
            m[i, at[part[at] == s]] = 1
    return m


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets: products of 0/1
    matrices over the elements that occur on both sides."""
    va, vb = (np.unique(np.concatenate(x)) if x else np.zeros(0, _U) for x in (a, b))
    if a is b:
        u, c = np.unique(np.concatenate(a), return_counts=True) if a else (va, va)
        shared = u[c > 1]
    else:
        shared = np.intersect1d(va, vb, assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(shared), 4096):
        hi = min(lo + 4096, len(shared))
        ma = _matrix(a, shared, lo, hi)
        out += ma @ (ma if a is b else _matrix(b, shared, lo, hi)).T
    return np.rint(out).astype(np.int64)


def links_within(sets: list[np.ndarray], regs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that span the connected components of some sets."""
    n = np.array([len(s) for s in sets])
    uni, out = _Union(len(sets)), []
    if len(sets) <= 48:
        est = np.triu(estimate(regs, regs) + 2, 1)
        left = len(sets) - 1
        for at in np.argsort(-est, axis=None, kind="stable")[:len(sets) * left // 2]:
            i, j = divmod(int(at), len(sets))
            # The smaller set can't hold the intersection it would take.
            if 100 * min(n[i], n[j]) < percent * max(n[i], n[j]) or uni.find(i) == uni.find(j):
                continue
            if near(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), n[i], n[j], percent):
                uni.join(i, j)
                out.append((i, j))
                left -= 1
                if not left:
                    break
        return out
    inter = intersections(sets, sets)
    hit = near(inter, n[:, None], n[None, :], percent)
    for i, j in zip(*np.nonzero(np.triu(hit, 1))):
        if uni.join(int(i), int(j)):
            out.append((int(i), int(j)))
    return out


def _groups(batches, keys: list[str]):
    """Consecutive rows with equal keys, across batch borders."""
    held = None
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = np.ones(len(pdf), bool)
        for k in keys:
            last &= (pdf[k] == pdf[k].iloc[-1]).to_numpy()
        cut_at = int(np.argmax(last))
        done, held = pdf.iloc[:cut_at], pdf.iloc[cut_at:].reset_index(drop=True)
        if len(done):
            yield from (g for _, g in done.groupby(keys, sort=False))
    if held is not None and len(held):
        yield held


def _sets(col) -> list[np.ndarray]:
    return [np.frombuffer(x, _U) for x in col]


def _small_links(percent, batches):
    for g in _groups(batches, ["grp"]):
        sets = _sets(g["shingles"])
        regs = np.frombuffer(b"".join(g["regs"]), np.uint16).reshape(len(g), REGISTERS)
        rep = g["rep"].to_numpy()
        found = links_within(sets, regs, percent)
        if found:
            yield pd.DataFrame({"a": [int(rep[i]) for i, _ in found], "b": [int(rep[j]) for _, j in found]})
    trim()


def _block_links(percent, batches):
    """Per block of a large group: links among its members and to the pivots,
    and each member's difference from the first pivot."""
    cols = ["kind", "grp", "block", "a", "b", "n", "lost", "pivot_n", "delta"]
    for g in _groups(batches, ["grp", "block"]):
        g = g.sort_values(["pivot", "degree", "rep"], ascending=[True, False, True], kind="stable")
        is_pivot = g["pivot"].to_numpy()
        sets, rep, n = _sets(g["shingles"]), g["rep"].to_numpy(), g["n"].to_numpy()
        regs = np.frombuffer(b"".join(g["regs"]), np.uint16).reshape(len(g), REGISTERS)
        members, pivots = np.flatnonzero(~is_pivot), np.flatnonzero(is_pivot)
        grp, block = int(g["grp"].iloc[0]), int(g["block"].iloc[0])
        rows = []
        uni = _Union(len(sets))
        for p in pivots:
            # Only sizes that could reach the threshold; likeliest first.
            fit = 100 * np.minimum(n[members], n[p]) >= percent * np.maximum(n[members], n[p])
            for i in members[np.argsort(-estimate(regs[p][None], regs[members])[0], kind="stable")]:
                if fit[np.searchsorted(members, i)] and uni.find(int(p)) != uni.find(int(i)) and near(np.isin(sets[i], sets[p], assume_unique=True).sum(), n[i], n[p], percent) and uni.join(int(p), int(i)):
                    rows.append(("link", grp, block, int(rep[i]), int(rep[p]), 0, 0, 0, b""))
        own = [sets[i] for i in members]
        for i, j in links_within(own, regs[members], percent):
            if uni.join(int(members[i]), int(members[j])):
                rows.append(("link", grp, block, int(rep[members[i]]), int(rep[members[j]]), 0, 0, 0, b""))
        hub = sets[pivots[0]]
        for i in members:
            common = np.isin(sets[i], hub, assume_unique=True)
            lost = np.setdiff1d(hub, sets[i][common], assume_unique=True)
            delta = np.sort(np.concatenate([lost, sets[i][~common]]))
            rows.append(("delta", grp, block, int(rep[i]), None, int(n[i]), len(lost), len(hub), delta.tobytes()))
        out = pd.DataFrame(rows, columns=cols)
        out["b"] = out["b"].astype("Int64")
        yield out
    trim()


def _cross_links(percent, batches):
    """Loose members of one block against all members of another. With c the
    pivot, |x & y| = |c| - |c-x| - |c-y| + |dx & dy|, d = difference from c."""
    for g in _groups(batches, ["grp", "left", "right"]):
        loose = g["loose"].to_numpy()
        if loose.all() or not loose.any():
            continue
        a, b = g[loose], g[~loose]
        da, db = _sets(a["delta"]), _sets(b["delta"])
        na, nb = a["n"].to_numpy(), b["n"].to_numpy()
        la, lb = a["lost"].to_numpy(), b["lost"].to_numpy()
        inter = int(g["pivot_n"].iloc[0]) - la[:, None] - lb[None, :] + intersections(da, db)
        hit = near(inter, na[:, None], nb[None, :], percent) & (a["a"].to_numpy()[:, None] != b["a"].to_numpy()[None, :])
        roots = {r: k for k, r in enumerate(pd.unique(pd.concat([a["root"], b["root"]])))}
        uni, rows = _Union(len(roots)), []
        ra, rb = a["root"].map(roots).to_numpy(), b["root"].map(roots).to_numpy()
        for i, j in zip(*np.nonzero(hit)):
            if uni.join(int(ra[i]), int(rb[j])):
                rows.append((int(a["a"].iloc[i]), int(b["a"].iloc[j])))
        if rows:
            yield pd.DataFrame(rows, columns=["a", "b"])
    trim()


def _block_count(classes, shingles):
    return F.ceil(F.greatest(classes / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def _large_group_links(large: DataFrame, rule: Rule) -> DataFrame | None:
    """Confirmed links of groups of more than one block (materialised)."""
    spark = large.sparkSession
    if not large.limit(1).count():
        return None
    blocks = F.col("blocks")
    members = large.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("pivot", F.lit(False))
    # The most central classes: those that share band keys with most others.
    top = (large.groupBy("grp").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("rep")))
    ranked = large.select("grp", "rep", "degree")
    for _ in range(PIVOTS - 1):
        rest = ranked.join(small_side(cut(top), 32), ["grp", "rep"], "left_anti")
        top = top.union(rest.groupBy("grp").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("rep")))
    top = cut(top)  # PIVOTS rows per large group
    pivots = (large.join(small_side(top, 32), ["grp", "rep"], "left_semi")
              .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("pivot", F.lit(True)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = staged(members.unionByName(pivots).repartition(parts, "grp", "block").sortWithinPartitions("grp", "block")
                   .mapInPandas(partial(_block_links, rule.percent), "kind string, grp long, block int, a long, b long, n long, lost long, pivot_n long, delta binary"),
                   "near-blocks")
    links = first.where("kind = 'link'").select("a", "b")
    roots = components(links)
    delta = (first.where("kind = 'delta'").join(roots, F.col("a") == F.col("node"), "left")
             .withColumn("root", F.coalesce("root", "a")).drop("node", "b", "kind"))
    sizes = delta.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("count"), F.sum(F.length("delta") / 8).alias("shingles"))
    main = cut(sizes.groupBy("grp").agg(F.max_by("root", F.struct("count", -F.col("root"))).alias("main"),
                                        _block_count(F.sum("count"), F.sum("shingles")).alias("blocks")))
    delta = staged(delta.join(small_side(main, 40), "grp").withColumn("loose", F.col("root") != F.col("main")), "near-deltas")
    loose = delta.where("loose")
    chunks = cut(loose.groupBy("grp").agg(_block_count(F.count(F.lit(1)), F.sum(F.length("delta") / 8)).alias("chunks")))
    if not chunks.limit(1).count():
        return links
    few = small_side(chunks, 32)
    # Loose classes in chunks of about BLOCK; every chunk meets every block.
    left = (loose.join(few, "grp")
            .withColumn("left", F.pmod(F.xxhash64("a", F.lit(1)), F.col("chunks")).cast("int"))
            .withColumn("right", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    right = (delta.join(few, "grp").withColumn("right", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
             .withColumn("left", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("loose", F.lit(False)))
    cols = ["grp", "left", "right", "loose", "a", "n", "lost", "pivot_n", "root", "delta"]
    crossed = (left.select(cols).unionByName(right.select(cols)).repartition(parts, "grp", "left", "right")
               .sortWithinPartitions("grp", "left", "right").mapInPandas(partial(_cross_links, rule.percent), "a long, b long"))
    return links.unionByName(crossed)


def link_classes(docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Confirmed links (a, b) that span the components of class representatives.
    ``classes(rep, n, bands)`` is materialised, one row per distinct set."""
    spark = docs.sparkSession
    keys = classes.select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1")
    met = staged(keys.join(small_side(staged(buckets, "near-buckets"), 40), "key").select("rep", "least", "c"), "near-stars")
    groups = components(met.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    # Classes of one document (it repeats with other texts) are one node here.
    info = classes.groupBy("rep").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sets"))
    members = staged(groups.join(info, F.col("node") == F.col("rep")).select("node", "root", "n", "sets"), "near-members")
    size = members.groupBy("root").agg(_block_count(F.sum("sets"), F.sum("n")).alias("blocks"))
    degree = met.groupBy("rep").agg(F.sum("c").alias("degree"))
    wanted = cut(members.join(size, "root").join(degree, F.col("node") == F.col("rep"))
                 .select(F.col("node").alias("doc_id"), F.col("root").alias("grp"), "blocks", "degree"))
    sets = staged(candidate_sets(docs, wanted, rule), "near-sets")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = (sets.where("blocks <= 1").repartition(parts, "grp").sortWithinPartitions("grp", "rep")
             .mapInPandas(partial(_small_links, rule.percent), "a long, b long"))
    large = _large_group_links(sets.where("blocks > 1"), rule)
    return small if large is None else small.unionByName(large)


def near_dedup(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    rows = staged(sketch(docs, rule), "near-sketch")
    usable = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = staged(usable.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"),
                                                         F.count(F.lit(1)).alias("c")), "near-classes")
    links = link_classes(docs, classes.select("rep", "n", "bands"), rule)
    # A document that repeats with other texts joins their classes.
    kind = F.struct("n", "h1", "h2")
    several = cut(usable.groupBy("doc_id").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi")).where("lo <> hi").select("doc_id"))
    if several.limit(1).count():
        own = usable.join(small_side(several, 16), "doc_id", "left_semi").join(classes.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"])
        links = links.unionByName(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    found = cut(components(links))
    # Only classes whose documents are not all their own representative.
    named = (classes.join(found, F.col("rep") == F.col("node"), "left")
             .select("n", "h1", "h2", "c", "rep", F.coalesce("root", "rep").alias("component_id"))
             .where("c > 1 OR component_id <> rep").select("n", "h1", "h2", "component_id"))
    out = rows.join(small_side(cut(named), 56), ["n", "h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` (all columns) with one row of each component of texts: the one of
    the smallest doc_id. Rows without words or without a doc_id stay."""
    cols = docs.columns
    repeated = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
                   .groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.limit(1).count():
        dropped = cut(near_dedup(docs, rule).where("not kept").select(F.col("doc_id").alias("gone")))
        return docs.join(small_side(dropped, 16), docs["doc_id"].cast("long") == dropped["gone"], "left_anti")
    # Ids that repeat don't name a row: rows get numbers of their own, written
    # with them, and a component's row is chosen by doc_id.
    named = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col("doc_id").cast("long").alias("id"), "text",
                               F.monotonically_increasing_id().alias("number")), "near-rows")
    rows = named.where("id is not null").select(F.col("number").alias("doc_id"), "text")
    found = staged(near_dedup(rows, rule).where("n_shingles > 0").select(F.col("doc_id").alias("number"), "component_id"), "near-result")
    held = found.join(named.select("number", "id"), "number")
    first = cut(held.groupBy("component_id").agg(F.min(F.struct("id", "number")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
                .select("component_id", F.col("f.number").alias("first")))
    gone = cut(found.join(small_side(first, 32), "component_id").where("number <> first").select("number"))
    return named.join(small_side(gone, 16), "number", "left_anti").select("row.*")
