"""Batch spam gate (TXT-11, AGG-1..5, JON-3, JON-6).

A batch (one hospital's reviews) is spam iff its mean type-token ratio is at
most 0.2 **and** its mean pairwise Jaccard similarity is at least 0.8, both
rounded to three decimals.

The mean TTR is linear. The mean pairwise Jaccard is, by definition, a sum over
all n(n-1)/2 pairs; we never materialise those pairs. Instead:

* **exact bounds, linear work.**
  Lower bound ``L``: pairs of *identical* non-empty token sets have J = 1 and
  every other pair J >= 0, so ``L = Σ C(m,2) / C(n,2)`` over groups of equal
  sets (m = multiplicity; sets compared by an md5 digest of the sorted set).
  Upper bound ``U``: J(A,B) <= min(|A|,|B|) / max(|A|,|B|); summed over pairs
  from the histogram of set sizes with a running sum -- the window runs over
  distinct sizes per batch, not over reviews.
* **tighter exact bounds, linear in the token postings** (:func:`pair_bounds`):
  Σ over pairs of |A∩B| = Σ_t C(df_t, 2), split by set size; J = I/(a+b-I)
  is convex in I, so the chord gives J <= I/max(a,b) and Jensen within a size
  class a lower bound. Windows run over the sizes of one token, never over
  its reviews.
* **estimate, linear work.** MinHash (Broder 1997): for a random hash h,
  P[min h(A) = min h(B)] = J(A,B), so the mean over pairs equals
  E_h[Σ_buckets C(c,2)] / C(n,2) where buckets group the batch by min-hash.
  K hashes ``(a_k·x + b_k) mod (2^31-1)`` over a 32-bit md5 prefix of the
  token. A review's K minima come from its own token array in one pass, so
  nothing is exploded or shuffled for them; they are counted in ``CELLS`` cells
  per hash (chance meetings of different minima in a cell are subtracted), so a
  batch sends at most K * CELLS counters per task however many reviews it has.
  Every hash gives one unbiased estimate of the batch mean; all pairs share the
  hashes, so the error of the mean does not shrink with the batch, only with K.
  It is measured and reported as ``jaccard_se``, the standard deviation over the
  hashes divided by sqrt(K). ``jaccard_estimate(whole=True)`` takes no cells: it
  counts the reviews of every minimum.

The first three rungs read one narrow row per distinct token set and batch (a
digest, its size, its multiplicity); token sets are never shuffled. Texts of the
batches still open then are tokenised again.

The gate decision is exact whenever a rung decides it (TTR above the threshold; a
rounded lower bound >= 0.8; a rounded upper bound < 0.8). What is left goes
through a sequential test (:func:`sequential_estimate`): every look doubles the
number of independent hashes for the batches still open and settles those whose
interval no longer holds the threshold; the admitted error ``ALPHA`` is spent in
equal parts over the ``LOOKS`` looks. ``decided_by`` names the rung; a batch that
the last look leaves open is ``undecided``; ``n_hashes`` and ``error`` (bound of the
probability that the verdict is wrong; 0 for exact rungs) are reported.

Exclusion of flagged batches (JON-6) is an anti join whose broadcast side is
materialised and measured first (see :func:`drop_spam_batches`).
"""

from __future__ import annotations

import random
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import JACCARD_THRESHOLD, TTR_THRESHOLD
from ..session import bound_batches, materialize, staging_path

MERSENNE_31 = (1 << 31) - 1
DEFAULT_NUM_HASHES = 64
# Hashes of the sequential test's first look (every further look doubles them),
# looks, and the probability of a wrong verdict that all looks together may spend.
FAMILY = 64
LOOKS = 4
ALPHA = 0.01
# Cells that the minima of one hash are counted in.
CELLS = 4096
# Token hashes that are put through the hashes together.
CHUNK = 1 << 18
HASH_SEED = 20240607


def hash_params(k: int = DEFAULT_NUM_HASHES, seed: int = HASH_SEED) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, MERSENNE_31), rng.randrange(0, MERSENNE_31)) for _ in range(k)]


def token_hash32(tok):
    """Base hash of a token: first 32 bits of its md5, as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint")


def review_token_stats(reviews: DataFrame, text_col: str = "reviews", keys=("batch", "review_id")) -> DataFrame:
    """AGG-1 per review: ``n_tokens``, ``n_distinct``, ``ttr`` and the distinct token set."""
    tok = T.ws_tokens(text_col)
    return (reviews.select(*keys, tok.alias("_tok"))
            .select(*keys, F.size("_tok").alias("n_tokens"), F.array_distinct("_tok").alias("token_set"))
            .withColumn("n_distinct", F.size("token_set"))
            .withColumn("ttr", F.when(F.col("n_tokens") > 0, F.col("n_distinct") / F.col("n_tokens"))
                        .otherwise(F.lit(0.0))))


def _set_key():
    return F.md5(F.array_join(F.array_sort("token_set"), " "))


def set_keys(stats: DataFrame, batch: str = "batch") -> DataFrame:
    """Reviews grouped by identical token set, the sets themselves left out:
    ``batch, _set`` (md5 of the sorted set), ``n_distinct, m`` (how many reviews
    share the set) and ``ttr_sum``. The bounds need no more."""
    return (stats.select(batch, _set_key().alias("_set"), "n_distinct", "ttr").groupBy(batch, "_set", "n_distinct")
            .agg(F.count(F.lit(1)).alias("m"), F.sum("ttr").alias("ttr_sum")))


def set_groups(stats: DataFrame, batch: str = "batch") -> DataFrame:
    """:func:`set_keys` with the ``token_set`` of every group."""
    return (stats.groupBy(batch, _set_key().alias("_set"), "n_distinct")
            .agg(F.first("token_set").alias("token_set"), F.count(F.lit(1)).alias("m"), F.sum("ttr").alias("ttr_sum")))


def _weighted(stats: DataFrame) -> DataFrame:
    """Rows with a multiplicity ``m`` and a key ``_set``: distinct sets as they
    are, single reviews with m = 1."""
    if "m" in stats.columns:
        return stats
    return stats.withColumn("m", F.lit(1).cast("bigint")).withColumn("_set", F.col("review_id").cast("string"))


def batch_ttr(stats: DataFrame, batch: str = "batch") -> DataFrame:
    """AGG-2: reviews per batch and mean TTR rounded to 3 (0 for no reviews)."""
    return stats.groupBy(batch).agg(F.count(F.lit(1)).alias("n"),
                                    F.coalesce(F.round(F.avg("ttr"), 3), F.lit(0.0)).alias("avg_ttr"))


def _dbl(c):
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _join_batch(left: DataFrame, right: DataFrame, batch: str, how: str, *also: str,
                broadcast: bool = False) -> DataFrame:
    """Join on the batch key (plus ``also`` columns) with NULL-safe equality on
    the batch: the gate's aggregates treat a NULL batch as a batch of its own,
    so every join between their results must too."""
    r = right.withColumnRenamed(batch, "_jb")
    for c in also:
        r = r.withColumnRenamed(c, f"_j_{c}")
    if broadcast:
        r = F.broadcast(r)
    cond = left[batch].eqNullSafe(r["_jb"])
    for c in also:
        cond = cond & (left[c] == r[f"_j_{c}"])
    return left.join(r, cond, how).drop("_jb", *[f"_j_{c}" for c in also])


def _pairs(n):
    """C(n, 2). Counts are products of row counts: at a third of a 100 TB
    table they pass 2^63, which ANSI BIGINT arithmetic rejects, so they are
    computed in double (exact below 2^53, 1e-16 relative above)."""
    n = _dbl(n)
    return n * (n - F.lit(1.0)) / F.lit(2.0)


def batch_bounds(stats: DataFrame, batch: str = "batch") -> DataFrame:
    """Per batch: ``n``, ``ttr_sum``, ``jaccard_lo``, ``jaccard_hi`` in one chain
    of aggregates (no join): identical sets -> histogram of set sizes -> batch.

    Lower bound: pairs of identical non-empty sets (J = 1); each histogram row
    carries the Σ C(m,2) of its sets. Upper bound: J(A,B) <= |B|/|A| for
    |B| <= |A|, summed over the size histogram with a running sum; the window
    runs over the distinct sizes of a batch (at most the longest review's
    token count), never over its reviews. (Empty sets are zeroed by a
    condition, not a filter: Catalyst would push a filter on the derived size,
    with the whole tokenisation, below the input exchange.)"""
    return bounds_from_sets(set_keys(stats, batch), batch)


def bounds_from_sets(sets: DataFrame, batch: str = "batch") -> DataFrame:
    """The arithmetic of :func:`batch_bounds` on ``(batch, n_distinct, m, ttr_sum)``
    rows, one per distinct token set."""
    d = F.col("n_distinct")
    hist = sets.groupBy(batch, "n_distinct").agg(
        F.sum("m").alias("c"),
        F.sum(F.when(d > 0, _pairs("m")).otherwise(F.lit(0.0))).alias("lo_part"),
        F.sum("ttr_sum").alias("ttr_sum"))
    w = Window.partitionBy(batch).orderBy("n_distinct").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_below", F.coalesce(F.sum(F.col("c") * d).over(w), F.lit(0)))
    contrib = F.when(d > 0, _pairs("c") + _dbl("c") * F.col("_below") / d).otherwise(F.lit(0.0))
    agg = hist.groupBy(batch).agg(F.sum("c").alias("n"), F.sum("ttr_sum").alias("ttr_sum"),
                                  F.sum("lo_part").alias("lo_num"), F.sum(contrib).alias("hi_num"))
    pairs = _pairs(F.col("n"))
    return agg.select(
        batch, "n", "ttr_sum",
        F.when(pairs > 0, F.col("lo_num") / pairs).otherwise(F.lit(0.0)).alias("jaccard_lo"),
        F.when(pairs > 0, F.col("hi_num") / pairs).otherwise(F.lit(0.0)).alias("jaccard_hi"))


def jaccard_bounds(stats: DataFrame, batch: str = "batch") -> DataFrame:
    """Exact lower / upper bounds of the mean pairwise Jaccard per batch."""
    return batch_bounds(stats, batch).drop("ttr_sum")


def _postings(stats: DataFrame, batch: str) -> DataFrame:
    """``(batch, _set, n_distinct, m, tok)``: one row per token of a set.

    explode_outer + an explicit filter above the generator: a plain explode
    makes Catalyst infer ``size(token_set) > 0`` and push it, tokenisation
    included, below the input exchange into the scan task."""
    return (_weighted(stats).select(batch, "_set", "n_distinct", "m", F.explode_outer("token_set").alias("tok"))
            .where(F.col("tok").isNotNull()))


def pair_bounds(stats: DataFrame, batch: str = "batch") -> DataFrame:
    """Tighter exact bounds of the mean pairwise Jaccard, from token document
    frequencies -- linear in the token postings, no pairs.

    With c(t, s) = reviews of set size s containing token t, the intersections
    summed over same-size pairs are W_s = Σ_t C(c(t,s), 2). J = I/(a+b-I) is
    convex in I on [0, min(a,b)] with J(0) = 0, so

    * upper: J <= I / max(a,b) (the chord); summed as Σ_s W_s/s plus, for pairs
      of different sizes, Σ_t Σ_b c(t,b)/b · #(reviews with t and a smaller
      size) -- a running count over the sizes of one token, never its reviews;
    * lower (Jensen, same-size pairs only, the others count 0):
      Σ_s P_s · Ī_s / (2s - Ī_s) with P_s = C(N_s, 2) and Ī_s = W_s / P_s.

    Both are tight when intersections are uniform (e.g. copies that differ
    by one token). Returns ``batch, n, pair_lo, pair_hi``."""
    h = _postings(stats, batch).groupBy(batch, "tok", "n_distinct").agg(F.sum("m").alias("c"))
    w = Window.partitionBy(batch, "tok").orderBy("n_distinct").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("_smaller", F.coalesce(F.sum("c").over(w), F.lit(0)))
    size = F.col("n_distinct").cast("double")
    per_size = h.groupBy(batch, "n_distinct").agg(
        F.sum(_pairs("c")).alias("w_s"),
        F.sum(_dbl("c") * F.col("_smaller") / size).alias("x_s"))
    sizes = _weighted(stats).groupBy(batch, "n_distinct").agg(F.sum("m").alias("n_s"))
    p_s = _pairs("n_s")
    ibar = F.col("w_s") / p_s
    lo_part = F.when((p_s > 0) & (size > 0), p_s * ibar / (F.lit(2.0) * size - ibar)).otherwise(F.lit(0.0))
    hi_part = F.when(size > 0, F.col("w_s") / size + F.col("x_s")).otherwise(F.lit(0.0))
    per = (_join_batch(sizes, per_size, batch, "left", "n_distinct").na.fill(0.0, ["w_s", "x_s"])
           .groupBy(batch).agg(F.sum("n_s").alias("n"), F.sum(lo_part).alias("lo_num"),
                               F.sum(hi_part).alias("hi_num")))
    pairs = _pairs(F.col("n"))
    return per.select(batch, "n",
                      F.when(pairs > 0, F.col("lo_num") / pairs).otherwise(F.lit(0.0)).alias("pair_lo"),
                      F.when(pairs > 0, F.col("hi_num") / pairs).otherwise(F.lit(0.0)).alias("pair_hi"))


def minhash_cells(first: int, count: int, n_cells: int = CELLS):
    """Column function: an array of token hashes (below 2^31 - 1) to the cells of
    its minima under hashes ``first .. first + count - 1``; NULL for an empty set.
    With ``MERSENNE_31`` cells these are the minima themselves."""
    params = hash_params(first + count)[first:]
    p, chunk = MERSENNE_31, CHUNK

    @F.pandas_udf("array<int>")
    def cells(hashes: pd.Series) -> pd.Series:
        out: list = [None] * len(hashes)
        some, held = [], 0

        def flush():
            starts = np.cumsum([0] + [len(x) for _, x in some[:-1]])
            flat = np.concatenate([x for _, x in some]).astype(np.int64)
            # a, b and x are below 2^31, so the product fits 64 bits.
            least = np.stack([np.minimum.reduceat((a * flat + b) % p, starts) for a, b in params], 1) % n_cells
            for (i, _), row in zip(some, least.astype(np.int32)):
                out[i] = row
            some.clear()

        for i, x in enumerate(hashes):
            if x is not None and len(x):
                some.append((i, x))
                held += len(x)
                if held >= chunk:
                    flush()
                    held = 0
        if some:
            flush()
        return pd.Series(out, dtype=object)

    return cells


def cell_counts(stats: DataFrame, first: int, count: int, batch: str = "batch", n_cells: int = CELLS) -> DataFrame:
    """``batch, k, cell, c``: reviews whose minimum under hash k lies in a cell.
    Each partition counts its cells before the exchange; counts add up."""
    bound_batches(stats.sparkSession)
    hashes = F.transform("token_set", lambda t: token_hash32(t) % F.lit(MERSENNE_31))
    rows = _weighted(stats).select(batch, "m", hashes.alias("x")).select(batch, "m", minhash_cells(first, count, n_cells)("x").alias("cells"))
    # explode_outer and a filter above it: see _postings
    stacked = (rows.select(batch, "m", F.posexplode_outer("cells").alias("i", "cell")).where(F.col("i").isNotNull())
               .withColumn("k", F.col("i") + F.lit(first)))
    return stacked.groupBy(batch, "k", "cell").agg(F.sum("m").alias("c"))


def pairs_per_hash(cells: DataFrame, batch: str = "batch") -> DataFrame:
    """Per batch and hash ``k``: ``coll``, the pairs whose min-hash agrees. Of
    pairs with other minima one in CELLS meets by chance; with c reviews in a
    cell and h in all, (Σ C(c,2) - C(h,2) / CELLS) / (1 - 1 / CELLS) is free of them."""
    met = cells.groupBy(batch, "k").agg(F.sum(_pairs("c")).alias("met"), F.sum("c").alias("held"))
    chance = F.lit(1.0 / CELLS)
    return met.select(batch, "k", ((F.col("met") - _pairs("held") * chance) / (F.lit(1.0) - chance)).alias("coll"))


def _per_hash(stats: DataFrame, first: int, count: int, batch: str) -> DataFrame:
    return pairs_per_hash(cell_counts(stats, first, count, batch), batch)


def _mean_over_hashes(n: DataFrame, per: DataFrame, num_hashes: int, batch: str, *keep: str) -> DataFrame:
    """``batch, n, keep, jaccard_est, jaccard_se`` from the pairs per hash."""
    per = per.groupBy(batch).agg(F.sum("coll").alias("_s"), F.coalesce(F.stddev_samp("coll"), F.lit(0.0)).alias("_sd"))
    pairs = _pairs(F.col("n"))

    def share(c, by):
        return F.when(pairs > 0, F.coalesce(F.col(c), F.lit(0.0)) / (pairs * F.lit(float(by)))).otherwise(F.lit(0.0))

    return _join_batch(n, per, batch, "left").select(
        batch, "n", *keep, share("_s", num_hashes).alias("jaccard_est"), share("_sd", num_hashes ** 0.5).alias("jaccard_se"))


def _whole_per_hash(stats: DataFrame, count: int, batch: str) -> DataFrame:
    """:func:`pairs_per_hash` from the minima themselves: no pair meets by chance."""
    minima = cell_counts(stats, 0, count, batch, MERSENNE_31)
    return minima.groupBy(batch, "k").agg(F.sum(_pairs("c")).alias("coll"))


def jaccard_estimate(stats: DataFrame, num_hashes: int = DEFAULT_NUM_HASHES, batch: str = "batch", whole: bool = False) -> DataFrame:
    """AGG-4b: MinHash estimate of the mean pairwise Jaccard per batch
    (``jaccard_est``, unrounded), its standard error ``jaccard_se`` and the
    batch size ``n``. ``whole`` counts the minima themselves, up to a row per hash
    and distinct minimum of a batch; else they are counted in ``CELLS`` cells."""
    n = _weighted(stats).groupBy(batch).agg(F.sum("m").alias("n"))
    per = _whole_per_hash(stats, num_hashes, batch) if whole else _per_hash(stats, 0, num_hashes, batch)
    return _mean_over_hashes(n, per, num_hashes, batch)


def look_z(alpha: float = ALPHA, looks: int = LOOKS) -> float:
    """Half width, in standard errors, of the interval of one look."""
    return NormalDist().inv_cdf(1 - alpha / (2 * looks))


def sequential_estimate(stats: DataFrame, open_: DataFrame, batch: str = "batch", threshold: float = JACCARD_THRESHOLD,
                        looks: int = LOOKS, alpha: float = ALPHA) -> DataFrame:
    """Verdicts by estimate for ``open_`` (materialised: batch, n, jaccard_lo,
    jaccard_hi); ``stats`` are the token sets of these batches.

    The first look takes FAMILY hashes, every further one adds as many as there
    were, for the batches not settled yet; the mean is over all hashes so far, held
    inside the exact bounds. A batch is
    settled when the threshold (0.0005 below the nominal one: the mean is rounded
    to three decimals first) lies more than ``look_z`` standard errors away. With
    equal parts of ``alpha`` for every look, the chance of a wrong verdict over all
    looks is at most ``alpha``. Returns batch, jaccard_est, jaccard_se, n_hashes,
    undecided and error of materialised looks."""
    z, edge = look_z(alpha, looks), threshold - 0.0005
    per, done, k = None, None, 0
    keys, n_open, small = _broadcast_if_small(open_.select(batch), batch)
    for look in range(looks):
        add = max(k, FAMILY)
        now = materialize(_per_hash(_only(stats, keys, batch, small), k, add, batch))  # one row a batch and hash
        per = now if per is None else per.unionByName(now)
        k += add
        est = _mean_over_hashes(open_, per, k, batch, "jaccard_lo", "jaccard_hi")
        est = est.withColumn("jaccard_est", F.least(F.greatest("jaccard_est", "jaccard_lo"), F.col("jaccard_hi")))
        off = F.abs(F.col("jaccard_est") - F.lit(edge))
        est = materialize(est.withColumn("undecided", ~(off > F.lit(z) * F.col("jaccard_se"))).withColumn("n_hashes", F.lit(k)).withColumn(
            "error", F.when(F.col("undecided"), F.pow("jaccard_se", F.lit(2.0)) / (F.pow("jaccard_se", F.lit(2.0)) + off * off))
            .otherwise(F.lit(alpha * (look + 1) / looks))))
        last = look == looks - 1
        found = (est if last else est.where("not undecided")).drop("n", "jaccard_lo", "jaccard_hi")
        done = found if done is None else done.unionByName(found)
        open_ = est.where("undecided").select(batch, "n", "jaccard_lo", "jaccard_hi")
        if not last:
            keys, n_open, small = _broadcast_if_small(open_.select(batch), batch)
        if last or not n_open:
            break
    return done


# Largest key set shipped to every task as a broadcast (the flagged / open
# batch lists are sized with a job before the join is chosen); beyond it the
# join shuffles and AQE splits a hot batch.
MAX_BROADCAST_BYTES = 64 << 20


def _broadcast_if_small(keys: DataFrame, col: str) -> tuple[DataFrame, int, bool]:
    """``(keys, row count, broadcast?)`` for a materialised key list: broadcast
    only when its measured size is within MAX_BROADCAST_BYTES."""
    row = keys.agg(F.count(F.lit(1)).alias("n"),
                   F.coalesce(F.sum(F.octet_length(col) + F.lit(16)), F.lit(0)).alias("bytes")).collect()[0]
    return keys, row["n"], row["bytes"] <= MAX_BROADCAST_BYTES


def _decide(base: DataFrame, ttr_threshold: float, jaccard_threshold: float) -> DataFrame:
    base = base.withColumn("avg_ttr", F.coalesce(F.round(F.col("ttr_sum") / F.col("n"), 3), F.lit(0.0)))
    lo3, hi3 = F.round("jaccard_lo", 3), F.round("jaccard_hi", 3)
    ttr_ok = F.col("avg_ttr") <= F.lit(ttr_threshold)
    return base.withColumn(
        "decided_by",
        F.when(~ttr_ok, F.lit("ttr")).when(lo3 >= F.lit(jaccard_threshold), F.lit("lower_bound"))
        .when(hi3 < F.lit(jaccard_threshold), F.lit("upper_bound")).otherwise(F.lit("estimate")))


def _tighten(base: DataFrame, pb: DataFrame, batch: str, jaccard_threshold: float) -> DataFrame:
    """Narrow [jaccard_lo, jaccard_hi] with the pair bounds and settle the
    batches still marked ``estimate`` that the tighter bounds decide."""
    lo = F.greatest("jaccard_lo", F.coalesce("pair_lo", "jaccard_lo"))
    hi = F.least("jaccard_hi", F.coalesce("pair_hi", "jaccard_hi"))
    out = _join_batch(base, pb.drop("n"), batch, "left").withColumn("jaccard_lo", lo).withColumn("jaccard_hi", hi)
    lo3, hi3 = F.round("jaccard_lo", 3), F.round("jaccard_hi", 3)
    still_open = F.col("decided_by") == "estimate"
    return out.withColumn(
        "decided_by",
        F.when(still_open & (lo3 >= F.lit(jaccard_threshold)), F.lit("pair_lower_bound"))
        .when(still_open & (hi3 < F.lit(jaccard_threshold)), F.lit("pair_upper_bound"))
        .otherwise(F.col("decided_by"))).drop("pair_lo", "pair_hi")


def _only(sets: DataFrame, batches: DataFrame, batch: str, small: bool) -> DataFrame:
    return _join_batch(sets, batches, batch, "left_semi", broadcast=small)


# Batch names that are written into a filter, which reaches the scan; more are joined.
MAX_IN_LIST = 1000


def _of_batches(reviews: DataFrame, keys: DataFrame, n: int, batch: str, small: bool) -> DataFrame:
    """The reviews of the listed batches (``n`` rows, materialised): a few names
    become a pushed-down filter, so only these batches are read again."""
    if n > MAX_IN_LIST:
        return _only(reviews, keys, batch, small)
    names = [r[0] for r in keys.collect()]
    cond = F.col(batch).isin([x for x in names if x is not None])
    return reviews.where(cond | F.col(batch).isNull() if None in names else cond)


def spam_gate(reviews: DataFrame, text_col: str = "reviews", batch: str = "batch",
              ttr_threshold: float = TTR_THRESHOLD, jaccard_threshold: float = JACCARD_THRESHOLD,
              num_hashes: int = DEFAULT_NUM_HASHES, looks: int = LOOKS, alpha: float = ALPHA,
              report: bool = True, all_bounds: bool = False) -> DataFrame:
    """AGG-5: one row per batch -- ``n, avg_ttr, avg_jaccard, jaccard_se,
    jaccard_lo, jaccard_hi, is_spam, decided_by, undecided, n_hashes, error``.

    Decision ladder: TTR; identical-set lower bound; size-histogram upper
    bound; token-frequency pair bounds (``pair_lower_bound`` /
    ``pair_upper_bound``); only then the sequential MinHash test, held inside the
    tightest exact bounds.

    The first bounds come from one narrow aggregate and are materialised. Token
    sets are written (not shuffled) only for the batches these leave open; pair
    bounds and looks read them. A phase is skipped when no batch is left. With
    ``report`` the settled batches get their ``avg_jaccard`` from ``num_hashes``
    hashes (NULL without); it changes no decision. ``all_bounds`` computes the pair
    bounds for every batch. The result is materialised, so callers can size and
    reuse it."""
    spark = reviews.sparkSession
    stats = review_token_stats(reviews, text_col, keys=(batch, "review_id"))
    base = materialize(_decide(bounds_from_sets(set_keys(stats, batch), batch), ttr_threshold, jaccard_threshold))

    def still_open():
        return _broadcast_if_small(base.where(F.col("decided_by") == "estimate").select(batch), batch)

    keys, n_open, small = still_open()
    if n_open:
        path = staging_path(spark, "open-token-sets")
        again = review_token_stats(_of_batches(reviews, keys, n_open, batch, small), text_col, keys=(batch, "review_id"))
        again.select(batch, "review_id", "n_distinct", "token_set").write.parquet(path)
        open_sets = spark.read.parquet(path)
    if n_open or all_bounds:
        base = materialize(_tighten(base, pair_bounds(stats if all_bounds else open_sets, batch), batch, jaccard_threshold))
        keys, n_open, small = still_open()
    parts = []
    if n_open:
        left = base.where(F.col("decided_by") == "estimate").select(batch, "n", "jaccard_lo", "jaccard_hi")
        parts.append(sequential_estimate(open_sets, left, batch, jaccard_threshold, looks, alpha))
    if report:
        rest = _join_batch(stats, keys, batch, "left_anti", broadcast=small) if n_open else stats
        parts.append(jaccard_estimate(rest, num_hashes, batch).drop("n").withColumn("undecided", F.lit(False))
                     .withColumn("n_hashes", F.lit(num_hashes)).withColumn("error", F.lit(0.0)))
    if parts:
        est = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        out = _join_batch(base, est, batch, "left")
    else:
        out = (base.withColumn("jaccard_est", F.lit(None).cast("double")).withColumn("jaccard_se", F.lit(None).cast("double"))
               .withColumn("undecided", F.lit(False)).withColumn("n_hashes", F.lit(0)).withColumn("error", F.lit(0.0)))
    # the estimate is clamped into the exact bounds (NULL stays NULL); bounds
    # that meet are the mean itself
    est, exact = F.col("jaccard_est"), F.col("jaccard_hi") - F.col("jaccard_lo") < 1e-12
    clamped = F.when(est.isNotNull(), F.least(F.greatest(est, F.col("jaccard_lo")), F.col("jaccard_hi")))
    out = (out.withColumn("avg_jaccard", F.round(clamped, 3))
           .withColumn("jaccard_se", F.when(exact & est.isNotNull(), F.lit(0.0)).otherwise(F.round("jaccard_se", 4))))
    is_spam = (F.when(F.col("decided_by") == "ttr", F.lit(False))
               .when(F.col("decided_by").isin("lower_bound", "pair_lower_bound"), F.lit(True))
               .when(F.col("decided_by").isin("upper_bound", "pair_upper_bound"), F.lit(False))
               .otherwise(F.col("avg_jaccard") >= F.lit(jaccard_threshold)))
    return materialize(out.select(
        batch, "n", "avg_ttr", "avg_jaccard", "jaccard_se", F.round("jaccard_lo", 6).alias("jaccard_lo"),
        F.round("jaccard_hi", 6).alias("jaccard_hi"), is_spam.alias("is_spam"), "decided_by",
        F.coalesce("undecided", F.lit(False)).alias("undecided"), F.coalesce("n_hashes", F.lit(0)).alias("n_hashes"),
        F.round(F.coalesce("error", F.lit(0.0)), 6).alias("error")))


def drop_spam_batches(reviews: DataFrame, gate: DataFrame, batch: str = "batch",
                      gate_materialized: bool = False) -> DataFrame:
    """JON-6: reviews of batches that passed the gate.

    The flagged-batch list (one row per flagged batch) is materialised (unless
    the gate already is: ``gate_materialized``) and sized first. Nothing
    flagged: the reviews pass untouched (no join). A list within
    MAX_BROADCAST_BYTES: broadcast anti join, so the reviews are never
    shuffled. Beyond that: a shuffle anti join on the batch key, where AQE's
    skew-join handling splits a hot batch across tasks."""
    flagged = gate.where(F.col("is_spam")).select(batch)
    if not gate_materialized:
        flagged = materialize(flagged)
    keys, n, small = _broadcast_if_small(flagged, batch)
    if n == 0:
        return reviews
    # null-safe: a NULL batch key is a batch of its own in the gate's
    # aggregates, so a flagged NULL batch must be excluded too
    return _join_batch(reviews, keys, batch, "left_anti", broadcast=small)
