"""Structured Streaming forms (STR-1, STR-2).

* :func:`prediction_stream` -- STR-1: landed review files (JSON lines or CSV)
  -> the same stateless gate + scorer as the batch path -> append sink with a
  checkpoint. Exactly the batch transform, per micro-batch.
* :func:`start_limit_query` -- SRT-3: the first reviews of every hospital, kept
  in order and evicted by smaller ids that come later.
* :func:`rollup_counter_stream` -- STR-2: running per-batch counters (six
  aspects x three classes) kept in streaming state; state size is
  batches x 18 longs. :func:`rollup_from_counters` turns the counters into the
  rollup table (AGG-8..10 are projections of the counters).

The reference keeps no event time, so there is no watermark: state is bounded
by the number of distinct batches (hospitals), not by time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions.lexicons import ASPECTS, NA_TOKENS, REVIEWS_LIMIT_APP
from ..operators import rollup, scoring
from ..plans import flow
from ..functions import text as T
from ..session import checkpoint_dir
from . import deltas, gate

REVIEW_SCHEMA = Ty.StructType([Ty.StructField("review_id", Ty.LongType()),
                               Ty.StructField("batch", Ty.StringType()),
                               Ty.StructField("reviews", Ty.StringType())])


def read_review_stream(spark: SparkSession, path: str, fmt: str = "json", schema=REVIEW_SCHEMA,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        # As the batch reader: the header must name the columns, NA tokens are NULL.
        df = r.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)
        return df.select(*[T.normalise_na(F.col(c), NA_TOKENS).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    return r.json(path)


def prediction_stream(reviews: DataFrame, scorer=None, text_col: str = "reviews") -> DataFrame:
    """STR-1: per review, six labels and the sentiment map (no state)."""
    scored = flow.score_reviews(flow.drop_null_reviews(reviews, text_col), scorer, text_col, keep_features=False)
    keep = [c for c in reviews.columns] + ASPECTS + ["sentiment"]
    return scored.select(*keep)


def rollup_counter_stream(scored: DataFrame, group_cols=("batch",), neutral: str = "drop") -> DataFrame:
    """STR-2: streaming conditional counts per group (update/complete mode)."""
    aggs = []
    for a in ASPECTS:
        s = rollup.score(a, neutral)
        aggs += [F.count_if(s == 1).alias(f"{a}__p"), F.count_if(s == 0).alias(f"{a}__u"),
                 F.count_if(s == -1).alias(f"{a}__n")]
    return scored.groupBy(*group_cols).agg(*aggs)


def rollup_from_counters(counters: DataFrame, group_cols=("batch",)) -> DataFrame:
    """Counters -> the rollup table (same columns as :func:`rollup.aspect_rollup`)."""
    rows = F.array(*[F.struct(F.lit(i).alias("aspect_ord"), F.lit(a).alias("Aspect"),
                              F.col(f"{a}__p").alias("n_pos"), F.col(f"{a}__u").alias("n_neu"),
                              F.col(f"{a}__n").alias("n_neg"))
                     for i, a in enumerate(ASPECTS)])
    out = rollup.percentages(counters.select(*group_cols, F.inline(rows)))
    return out.select(*group_cols, "aspect_ord", "Aspect", "Positive", "Neutral", "Negative",
                      "Sentiment", "signed_pct")


def _checkpoint(spark: SparkSession, kind: str, source: str, sink: str, given: str | None) -> str:
    """A folder of its own for every (source, sink) pair under the shared
    checkpoint folder, so that no query picks up another one's offsets."""
    name = hashlib.sha256(f"{source}\n{sink}".encode()).hexdigest()[:24]
    return given or f"{checkpoint_dir(spark).rstrip('/')}/streams/{kind}-{name}"


def start_prediction_query(spark: SparkSession, source: str, sink: str, fmt: str = "json",
                           checkpoint: str | None = None, available_now: bool = False, scorer=None):
    """Run STR-1 into a parquet sink (append). Unless given, the checkpoint is
    derived from source and sink."""
    out = prediction_stream(read_review_stream(spark, source, fmt), scorer)
    w = (out.drop("sentiment").writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", _checkpoint(spark, "predict", source, sink, checkpoint)).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_rollup_query(spark: SparkSession, source: str, table: str, fmt: str = "json",
                       checkpoint: str | None = None, available_now: bool = False, scorer=None):
    """Run STR-2: counters in streaming state; each micro-batch writes only the
    groups it changed into a table of deltas with compaction (``deltas``).
    :func:`current_counters` and :func:`current_rollup` read the newest counters
    of every group."""
    counters = rollup_counter_stream(prediction_stream(read_review_stream(spark, source, fmt), scorer))

    def publish(df: DataFrame, epoch_id: int) -> None:
        deltas.publish(df, table, epoch_id, deltas.newest_wins(("batch",)))

    w = (counters.writeStream.outputMode("update")
         .option("checkpointLocation", _checkpoint(spark, "rollup", source, table, checkpoint)).foreachBatch(publish))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def current_counters(spark: SparkSession, table: str, group_cols=("batch",)) -> DataFrame:
    """Newest counters of every group (counters only grow, the last epoch wins)."""
    return deltas.read(spark, table, deltas.newest_wins(tuple(group_cols))).drop("epoch")


def start_gate_query(spark: SparkSession, source: str, table: str, fmt: str = "json", checkpoint: str | None = None,
                     available_now: bool = False, max_files_per_trigger: int | None = None):
    """Run the spam gate over landed files: every micro-batch adds its counters to
    ``table``; :func:`gate.current_gate` gives the verdicts."""
    w = (read_review_stream(spark, source, fmt, max_files_per_trigger=max_files_per_trigger).writeStream
         .option("checkpointLocation", _checkpoint(spark, "gate", source, table, checkpoint)).foreachBatch(gate.publish(table)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _first(rows: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` smallest ids of every batch, one row an id (that of its newest
    epoch, of equal ones the smallest). The rank comes first and is cut before the
    exchange; repeats of an id share it and take no other id's place."""
    values = [c for c in rows.columns if c not in ("batch", "review_id", "epoch")]
    rank = F.dense_rank().over(Window.partitionBy("batch").orderBy("review_id"))
    kept = rows.withColumn("_rank", rank).where(F.col("_rank") <= limit)
    best = F.min(F.struct((-F.col("epoch")).alias("_age"), *values)).alias("_v")
    return kept.groupBy("batch", "review_id").agg(best).select(
        "batch", "review_id", *[F.col("_v")[c].alias(c) for c in values], (-F.col("_v._age")).alias("epoch"))


def start_limit_query(spark: SparkSession, source: str, table: str, fmt: str = "json", checkpoint: str | None = None,
                      available_now: bool = False, max_files_per_trigger: int | None = None, limit: int = REVIEWS_LIMIT_APP):
    """SRT-3 on the stream: ``table`` keeps the first ``limit`` reviews of every
    batch by id, in whatever order they arrive. A micro-batch adds its own first
    ones; compaction evicts what smaller ids have displaced, so the state holds at
    most ``limit`` rows a batch in the base and in each delta. NULL reviews are
    dropped; a NULL id is one id and comes first."""
    def publish(df: DataFrame, epoch_id: int) -> None:
        rows = _first(df.withColumn("epoch", F.lit(epoch_id).cast("long")), limit)
        deltas.publish(rows.drop("epoch"), table, epoch_id, lambda r: _first(r, limit))

    reviews = flow.drop_null_reviews(read_review_stream(spark, source, fmt, max_files_per_trigger=max_files_per_trigger))
    w = reviews.writeStream.option("checkpointLocation", _checkpoint(spark, "limit", source, table, checkpoint)).foreachBatch(publish)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def current_first(spark: SparkSession, table: str, limit: int = REVIEWS_LIMIT_APP) -> DataFrame:
    """The first reviews of every batch as of the newest micro-batch, ranked."""
    rows = deltas.read(spark, table, lambda r: _first(r, limit)).drop("epoch")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("batch").orderBy("review_id")))


def current_rollup(spark: SparkSession, table: str, group_cols=("batch",)) -> DataFrame:
    """The rollup table as of the newest micro-batch."""
    return rollup_from_counters(current_counters(spark, table, group_cols), group_cols)


__all__ = ["read_review_stream", "prediction_stream", "rollup_counter_stream", "rollup_from_counters",
           "start_prediction_query", "start_rollup_query", "start_gate_query", "start_limit_query", "current_first", "current_counters", "current_rollup", "scoring"]
