"""The spam gate on a stream (AGG-1..5): mergeable state per batch.

A micro-batch contributes counters of its own rows alone, which add up in any
order: how many reviews have a token set of this digest and size and the sum of
their type-token ratios (first three rungs), and how many have their minimum under
hash k in a cell (estimate). No text, token or review is kept. The state is a table
of deltas with compaction (``deltas``), so repeating a micro-batch changes nothing.

The verdict is the batch gate's with one look of ``FAMILY`` hashes: TTR, identical
sets, set sizes, else the estimate inside these bounds. ``undecided`` marks batches
whose interval holds the threshold. (Pair bounds need every token's counts and are
left to the batch gate.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import JACCARD_THRESHOLD, TTR_THRESHOLD
from ..operators import spam
from ..plans import flow
from . import deltas

KEYS = ("batch", "digest", "n_distinct", "k", "cell")
VALUES = ("c", "ttr_sum")
_merge = deltas.sums(KEYS, VALUES)


def gate_counters(reviews: DataFrame, text_col: str = "reviews", batch: str = "batch", num_hashes: int = spam.FAMILY) -> DataFrame:
    """Additive counters of some reviews: rows with a digest (set counts) and
    rows with a hash number ``k`` (cell counts)."""
    stats = spam.review_token_stats(flow.drop_null_reviews(reviews, text_col), text_col, keys=(batch, "review_id"))
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    sets = spam.set_keys(stats, batch).select(F.col(batch).alias("batch"), F.col("_set").alias("digest"), "n_distinct", none_i.alias("k"), none_i.alias("cell"),
                                              F.col("m").alias("c"), "ttr_sum")
    cells = spam.cell_counts(stats, 0, num_hashes, batch).select(
        F.col(batch).alias("batch"), none_s.alias("digest"), none_i.alias("n_distinct"), "k", "cell", "c", F.lit(0.0).alias("ttr_sum"))
    return sets.unionByName(cells)


def gate_from_counters(counters: DataFrame, num_hashes: int = spam.FAMILY, ttr_threshold: float = TTR_THRESHOLD,
                       jaccard_threshold: float = JACCARD_THRESHOLD) -> DataFrame:
    """batch, n, avg_ttr, avg_jaccard, jaccard_se, is_spam, decided_by, undecided."""
    sets = counters.where("digest is not null").select("batch", "n_distinct", F.col("c").alias("m"), "ttr_sum")
    base = spam.materialize(spam._decide(spam.bounds_from_sets(sets), ttr_threshold, jaccard_threshold))
    per = spam.pairs_per_hash(counters.where("k is not null").select("batch", "k", "cell", "c"))
    est = spam._mean_over_hashes(base, per, num_hashes, "batch", "avg_ttr", "decided_by", "jaccard_lo", "jaccard_hi")
    est = est.withColumn("est", F.least(F.greatest("jaccard_est", "jaccard_lo"), F.col("jaccard_hi")))
    estimated = F.col("decided_by") == "estimate"
    open_ = F.abs(F.col("est") - F.lit(jaccard_threshold - 0.0005)) <= F.lit(spam.look_z(looks=1)) * F.col("jaccard_se")
    is_spam = (F.when(F.col("decided_by") == "lower_bound", F.lit(True)).when(estimated, F.round("est", 3) >= F.lit(jaccard_threshold))
               .otherwise(F.lit(False)))
    return est.select("batch", "n", "avg_ttr", F.round("est", 3).alias("avg_jaccard"), F.round("jaccard_se", 4).alias("jaccard_se"),
                      is_spam.alias("is_spam"), "decided_by", (estimated & open_).alias("undecided"))


def publish(table: str, every: int = deltas.EVERY):
    """A ``foreachBatch`` function that adds a micro-batch of reviews."""
    def add(df: DataFrame, epoch_id: int) -> None:
        deltas.publish(gate_counters(df), table, epoch_id, _merge, every)
    return add


def current_gate(spark: SparkSession, table: str) -> DataFrame:
    """Verdicts as of the newest micro-batch."""
    return gate_from_counters(deltas.read(spark, table, _merge))
