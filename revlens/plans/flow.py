"""End-to-end review analysis as Spark jobs.

    reviews(batch, review_id, reviews)
      -> drop NULL reviews                         (PRJ-2)
      -> spam gate per batch, drop flagged batches  (AGG-1..5, JON-6)
      -> text features: lower, word hits            (TXT-1, JON-1)
      -> gate + score per aspect                    (TXT-2, SCR-1..6)
      -> tags / rollup / masked rows                (TXT-4, AGG-6..11, TXT-7)

Shuffles: the gate's per-batch aggregates (partial aggregation first), the
anti join (broadcast at run time by AQE when the flagged list is small) and the
rollup aggregate. Everything between is one narrow stage per partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import all_keywords
from ..operators import masking, rollup, scoring, spam, tagging
from ..session import staging_path
from ..sources.reviews import write_results_csv


def drop_null_reviews(reviews: DataFrame, text_col: str = "reviews") -> DataFrame:
    """PRJ-2: drop NULL reviews, cast to string."""
    return reviews.where(F.col(text_col).isNotNull()).withColumn(text_col, F.col(text_col).cast("string"))


def score_reviews(reviews: DataFrame, scorer=None, text_col: str = "reviews", keep_features: bool = True,
                  engine: str | None = None) -> DataFrame:
    """Features + gate + scorer: six label columns, ``sentiment`` map, and (with
    ``keep_features``) ``_low`` / ``_hits`` for tagging and masking."""
    scorer = scorer or scoring.LinearScorer()
    vocab = scorer.vocab if isinstance(scorer, scoring.LinearScorer) and not scorer.max_tokens else None
    # Only keywords that something downstream reads: tags and masks when the
    # features are kept, else just the scorer's vocabulary and the gates.
    feats = tagging.with_text_features(reviews, text_col, all_keywords() if keep_features else [], vocab, engine=engine)
    gates = tagging.gates_from_mask()
    if isinstance(scorer, (scoring.ModelScorer, scoring.PipelineScorer)):
        out = scorer.apply(feats, gates, text_col)
    else:
        out = scorer.apply(feats, gates)
    out = out.withColumn("sentiment", scoring.sentiment_map()).drop(tagging.GATE_MASK)
    if not keep_features:
        out = out.drop(tagging.LOW, tagging.HITS, tagging.HITS_AT)
    return out


def clean_reviews(reviews: DataFrame, text_col: str = "reviews", batch: str = "batch") -> DataFrame:
    """Non-null reviews of the batches that pass the spam gate."""
    nn = drop_null_reviews(reviews, text_col)
    gate = spam.spam_gate(nn, text_col, batch, report=False)
    return spam.drop_spam_batches(nn, gate, batch, gate_materialized=True)


@dataclass
class Analysis:
    gate: DataFrame
    scored: DataFrame
    rollup: DataFrame
    masked: DataFrame


def analyze(reviews: DataFrame, scorer=None, text_col: str = "reviews", batch: str = "batch",
            neutral: str = "drop") -> Analysis:
    """All outputs of one run. The gate runs when this is called (its phases
    are materialised); the frames after it are lazy."""
    nn = drop_null_reviews(reviews, text_col)
    gate = spam.spam_gate(nn, text_col, batch)
    passed = spam.drop_spam_batches(nn, gate, batch, gate_materialized=True)
    scored = score_reviews(passed, scorer, text_col)
    return Analysis(gate=gate, scored=scored,
                    rollup=rollup.aspect_rollup(scored, (batch,), neutral),
                    masked=masking.masked_rows(scored, text_col, keys=(batch, "review_id")))


def run_and_write(spark: SparkSession, reviews: DataFrame, out_dir: str, scorer=None,
                  text_col: str = "reviews", batch: str = "batch",
                  all_bounds: bool = False) -> dict[str, str]:
    """Materialise a full run. The scored reviews are written once (a table in
    the shared checkpoint folder cuts the lineage and survives lost executors);
    rollup and masked rows are then derived from that table.

    ``all_bounds`` also computes the pair bounds of batches that the first
    bounds settle; the decisions are the same."""
    nn = drop_null_reviews(reviews, text_col)
    gate = spam.spam_gate(nn, text_col, batch, all_bounds=all_bounds)
    gate_path = f"{out_dir}/batch_spam"
    gate.write.mode("overwrite").parquet(gate_path)
    gate = spark.read.parquet(gate_path)
    passed = spam.drop_spam_batches(nn, gate, batch, gate_materialized=True)
    scored_path = staging_path(spark, "scored")
    score_reviews(passed, scorer, text_col).write.mode("overwrite").parquet(scored_path)
    scored = spark.read.parquet(scored_path)
    paths = {"batch_spam": gate_path}
    paths["aspect_rollup"] = f"{out_dir}/aspect_rollup"
    rollup.aspect_rollup(scored, (batch,)).write.mode("overwrite").parquet(paths["aspect_rollup"])
    paths["sentiment_results"] = f"{out_dir}/sentiment_results"
    write_results_csv(masking.export_frame(masking.masked_rows(scored, text_col, keys=(batch, "review_id"))),
                      paths["sentiment_results"])
    return paths
