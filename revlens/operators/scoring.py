"""Sentiment scoring (SCR-1..6).

The reference runs one fine-tuned sequence classifier per aspect, but ships no
weights, so its predictions cannot be reproduced. Scoring is therefore an
interface with three implementations:

* :class:`LinearScorer` (default) -- our own bag-of-words model with small
  integer weights, written as native column expressions (no Python worker, no
  shuffle). Integer logits make labels deterministic across engines.
* :class:`PipelineScorer` -- one fitted ``pyspark.ml`` ``PipelineModel`` per
  aspect, run in the JVM;
* :class:`ModelScorer` -- any per-aspect model supplied as a loader callable,
  run in an Arrow-batched pandas UDF that receives only the text and the gate
  flags; models are loaded once per worker process and score only gated (review,
  aspect) pairs.

Both produce, per review, six label columns (``""`` when the aspect is not
gated) and a ``sentiment`` map, the shape of the reference's ``/predict``.
"""

from __future__ import annotations

import sys
import types
import uuid
from functools import reduce
from typing import Callable, Iterator, Tuple

import pandas as pd

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import literals as L
from ..functions import text as T
from ..functions.lexicons import ASPECTS, CONFIDENCE_THRESHOLD, SENTIMENT_LABELS
from . import tagging

# Functions here run inside Python workers; ship this module's code with the
# task (pickled by value) so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Our default scorer weights: (aspect or '*', token, w_neg, w_neu, w_pos).
# '*' rows apply to every aspect; aspect rows add to them.
DEFAULT_WEIGHTS = [
    ("*", "kind", 0, 0, 2), ("*", "helpful", 0, 0, 2), ("*", "excellent", 0, 0, 3),
    ("*", "good", 0, 0, 2), ("*", "great", 0, 0, 2), ("*", "polite", 0, 0, 2),
    ("*", "friendly", 0, 0, 2), ("*", "caring", 0, 0, 2), ("*", "professional", 0, 0, 1),
    ("*", "amazing", 0, 0, 3), ("*", "spotless", 0, 0, 2), ("*", "fresh", 0, 0, 1),
    ("*", "clean", 0, 0, 1), ("*", "reasonable", 0, 0, 1), ("*", "quick", 0, 0, 1),
    ("*", "spacious", 0, 0, 1), ("*", "well", 0, 0, 1),
    ("*", "rude", 3, 0, 0), ("*", "bad", 2, 0, 0), ("*", "worst", 3, 0, 0),
    ("*", "broke", 2, 0, 0), ("*", "dirty", 3, 0, 0), ("*", "foul", 2, 0, 0),
    ("*", "terrible", 3, 0, 0), ("*", "ignored", 2, 0, 0), ("*", "expensive", 2, 0, 0),
    ("*", "unhelpful", 2, 0, 0), ("*", "overpriced", 2, 0, 0), ("*", "slow", 2, 0, 0),
    ("*", "horrible", 3, 0, 0), ("*", "nightmare", 2, 0, 0), ("*", "closed", 1, 0, 0),
    ("*", "crowded", 1, 0, 0), ("*", "long", 1, 0, 0), ("*", "worthless", 2, 0, 0),
    ("*", "ok", 0, 2, 0), ("*", "average", 0, 2, 0), ("*", "nearby", 0, 1, 0),
    ("*", "nothing", 0, 1, 0), ("*", "explained", 0, 1, 0), ("*", "visit", 0, 1, 0),
    ("*", "special", 0, 1, 0),
    ("cost", "cheap", 0, 0, 2), ("cost", "value", 0, 0, 1),
    ("waitingtime", "quick", 0, 0, 1), ("waitingtime", "waited", 1, 0, 0),
    ("waitingtime", "hours", 1, 0, 0), ("cleanliness", "smelled", 1, 0, 0),
]
DEFAULT_BIAS = (0, 1, 0)

# Weight tables up to this size are compiled into the plan as literals; larger
# ones are joined as a table (same results).
MAX_LITERAL_WEIGHTS = 5000
# Texts handed to a model at once.
MODEL_BATCH = 64

PRESENT = tagging.PRESENT


def _label_sql(name: str, threshold: float) -> str:
    lg = f"`{name}`"
    labels = ", ".join(f"'{x}'" for x in SENTIMENT_LABELS)
    return (f"CASE WHEN {_confidence_sql(name)} < {float(threshold)!r}D THEN 'Neutral' "
            f"ELSE element_at(array({labels}), CAST(array_position({lg}, array_max({lg})) AS INT)) END")


def _confidence_sql(name: str) -> str:
    lg = f"`{name}`"
    return f"(1.0D / aggregate({lg}, 0.0D, (acc, x) -> acc + exp(CAST(x AS DOUBLE) - array_max({lg}))))"


def label_from_logits(logits, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    """SCR-1: softmax -> argmax (first max wins) -> label; ``Neutral`` below the
    confidence threshold (cannot fire for three classes, kept as a parameter).
    A column name is rendered as one SQL expression (one JVM call)."""
    if isinstance(logits, str) and "`" not in logits:
        return F.expr(_label_sql(logits, threshold))
    lg = T.col(logits)
    m = F.array_max(lg)
    idx = F.array_position(lg, m)
    conf = confidence(lg)
    lab = F.element_at(F.array(*[F.lit(x) for x in SENTIMENT_LABELS]), idx.cast("int"))
    return F.when(conf < F.lit(threshold), F.lit("Neutral")).otherwise(lab)


def confidence(logits) -> Column:
    """Largest softmax probability: 1 / Σ exp(x - max)."""
    if isinstance(logits, str) and "`" not in logits:
        return F.expr(_confidence_sql(logits))
    lg = T.col(logits)
    m = F.array_max(lg)
    denom = F.aggregate(lg, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - m))
    return F.lit(1.0) / denom


class LinearScorer:
    """Integer-weight bag-of-words scorer over distinct lower-cased word tokens."""

    def __init__(self, weights=None, bias=DEFAULT_BIAS, max_tokens: int | None = None):
        self.weights = list(weights if weights is not None else DEFAULT_WEIGHTS)
        self.bias = tuple(bias)
        self.max_tokens = max_tokens

    @property
    def vocab(self) -> list[str]:
        return sorted({t for _, t, *_ in self.weights})

    def table(self, aspect: str) -> dict[str, tuple[int, int, int]]:
        out: dict[str, list[int]] = {}
        for a, t, *w in self.weights:
            if a in ("*", aspect):
                acc = out.setdefault(t, [0, 0, 0])
                for i in range(3):
                    acc[i] += w[i]
        return {t: tuple(w) for t, w in out.items()}

    def present_column(self, low=tagging.LOW) -> Column:
        """Distinct weight-vocabulary tokens of the review (SCR-3 truncation optional)."""
        words = self._words(low) if self.max_tokens else T.word_tokens(low)
        return F.array_intersect(L.const(self.vocab, "array<string>"), words)

    def logits(self, aspect: str, present=PRESENT) -> Column:
        tab = self.table(aspect)
        if not tab:
            return F.array(*[F.lit(float(b)) for b in self.bias])
        keys = sorted(tab)
        maps = [{t: int(tab[t][c]) for t in keys} for c in range(3)]
        quoted = [L.sql_literal(m) for m in maps]
        if isinstance(present, str) and "`" not in present and all(q is not None for q in quoted):
            # one SQL expression: three integer sums of the token weights
            parts = [f"CAST(aggregate(`{present}`, {int(self.bias[c])}, "
                     f"(acc, t) -> acc + coalesce(try_element_at({quoted[c]}, t), 0)) AS DOUBLE)"
                     for c in range(3)]
            return F.expr("array(" + ", ".join(parts) + ")")
        cols = []

        def adder(m):
            return lambda acc, t: acc + F.coalesce(F.try_element_at(m, t), F.lit(0))

        for c in range(3):
            cols.append(F.aggregate(T.col(present), F.lit(int(self.bias[c])), adder(L.const(maps[c]))).cast("double"))
        return F.array(*cols)

    @property
    def joined(self) -> bool:
        return len(self.weights) > MAX_LITERAL_WEIGHTS

    def _words(self, low=tagging.LOW) -> Column:
        words = F.filter(T.word_tokens(low), lambda w: w != F.lit(""))
        return F.slice(words, 1, self.max_tokens) if self.max_tokens else words

    def _apply_joined(self, df: DataFrame, gates: dict[str, Column]) -> DataFrame:
        """Logits by a join with the weight table: rows of equal text share
        their distinct words, so (text hash, word) pairs are joined and summed
        per text, and the sums come back by the same key."""
        spark = df.sparkSession
        rows = [(a, t, *map(int, w)) for a, t, *w in self.weights]
        table = spark.createDataFrame(rows, "aspect string, token string, w0 long, w1 long, w2 long")
        sums = [F.coalesce(F.sum(F.when(F.col("aspect").isin("*", a), F.col(f"w{c}"))), F.lit(0)).alias(f"{a}__{c}")
                for a in ASPECTS for c in range(3)]
        per_token = table.groupBy("token").agg(*sums)
        key = F.sha2(F.col(tagging.LOW), 256)
        out = df.withColumn("_text_key", key)
        pairs = out.select("_text_key", tagging.LOW).dropDuplicates(["_text_key"]).select(
            "_text_key", F.explode(F.array_distinct(self._words())).alias("token"))
        scored = (pairs.join(per_token, "token").groupBy("_text_key")
                  .agg(*[F.sum(f"{a}__{c}").alias(f"{a}__{c}") for a in ASPECTS for c in range(3)]))
        out = out.join(scored, "_text_key", "left")
        out = out.drop(*[c for c in [f"logits_{a}" for a in ASPECTS] + ASPECTS if c in df.columns])
        out = out.select("*", *[F.when(gates[a], F.array(*[
            (F.coalesce(F.col(f"{a}__{c}"), F.lit(0)) + int(self.bias[c])).cast("double") for c in range(3)]))
            .alias(f"logits_{a}") for a in ASPECTS])
        out = out.drop("_text_key", PRESENT, *[f"{a}__{c}" for a in ASPECTS for c in range(3)])
        return out.select("*", *[F.when(F.col(f"logits_{a}").isNotNull(), label_from_logits(f"logits_{a}"))
                                 .otherwise(F.lit("")).alias(a) for a in ASPECTS])

    def apply(self, df: DataFrame, gates: dict[str, Column]) -> DataFrame:
        """Add ``logits_<aspect>`` (NULL when not gated) and ``<aspect>`` labels
        (two projections, not twelve)."""
        if self.joined:
            return self._apply_joined(df, gates)
        out = df if (PRESENT in df.columns and not self.max_tokens) else df.withColumn(PRESENT, self.present_column())
        replaced = [c for c in [f"logits_{a}" for a in ASPECTS] + ASPECTS if c in out.columns]
        out = out.drop(*replaced)
        out = out.select("*", *[F.when(gates[a], self.logits(a)).alias(f"logits_{a}") for a in ASPECTS])
        out = out.select("*", *[F.when(F.col(f"logits_{a}").isNotNull(), label_from_logits(f"logits_{a}"))
                                .otherwise(F.lit("")).alias(a) for a in ASPECTS])
        return out.drop(PRESENT)


def worker_models(key: str, load: Callable[[], dict]) -> dict:
    """Models of this worker process. The module travels by value with every
    task, so they are kept in a module of the process itself."""
    cache = sys.modules.setdefault("_revlens_models", types.ModuleType("_revlens_models")).__dict__
    if key not in cache:
        cache[key] = load()
    return cache[key]


class ModelScorer:
    """SCR-2(c): per-aspect models run in Python workers over Arrow batches.

    ``load`` is called once per Python worker process (workers are reused by
    later tasks) and returns ``{aspect: fn}`` where ``fn(list[str]) ->
    array-like (n, 3)`` of logits; ``fn`` gets at most ``MODEL_BATCH`` texts.
    Aspects without a model get ``Neutral`` (SCR-4). Texts are passed in
    original case; truncation to ``max_length`` model tokens is the model's
    business (SCR-3). Only the text and the six gate flags cross into Python
    (a scalar-iterator pandas UDF returning a struct of labels); every other
    column stays in the JVM, and each model sees only its gated texts.
    """

    def __init__(self, load: Callable[[], dict], threshold: float = CONFIDENCE_THRESHOLD):
        self.load = load
        self.threshold = threshold
        self.key = uuid.uuid4().hex

    def apply(self, df: DataFrame, gates: dict[str, Column], text_col: str = "reviews") -> DataFrame:
        load, thr, key = self.load, self.threshold, self.key
        label_type = Ty.StructType([Ty.StructField(a, Ty.StringType(), False) for a in ASPECTS])

        @F.pandas_udf(label_type)
        def run(batches: Iterator[Tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
            import numpy as np
            models = worker_models(key, load)
            for texts, flags in batches:
                labels_by_aspect = {}
                for a in ASPECTS:
                    gate = flags[a].fillna(False).to_numpy(dtype=bool)
                    labels = np.full(len(texts), "", dtype=object)
                    if gate.any():
                        fn = models.get(a)
                        if fn is None:
                            labels[gate] = "Neutral"
                        else:
                            todo = texts[gate].astype(str).tolist()
                            lg = np.concatenate([np.asarray(fn(todo[k:k + MODEL_BATCH]), dtype=float)
                                                 for k in range(0, len(todo), MODEL_BATCH)])
                            z = np.exp(lg - lg.max(axis=1, keepdims=True))
                            p = z / z.sum(axis=1, keepdims=True)
                            idx = p.argmax(axis=1)
                            conf = p[np.arange(len(idx)), idx]
                            lab = np.array(SENTIMENT_LABELS, dtype=object)[idx]
                            lab[conf < thr] = "Neutral"
                            labels[gate] = lab
                    labels_by_aspect[a] = labels
                yield pd.DataFrame(labels_by_aspect)

        flags = F.struct(*[gates[a].alias(a) for a in ASPECTS])
        out = df.drop(*[a for a in ASPECTS if a in df.columns])
        out = out.withColumn("_labels", run(F.col(text_col), flags))
        return out.select("*", *[F.col("_labels")[a].alias(a) for a in ASPECTS]).drop("_labels")


class PipelineScorer:
    """SCR-2(b): one fitted ``pyspark.ml`` ``PipelineModel`` per aspect, run
    in the JVM (no Python worker).

    Each model reads the review text from ``input_col`` and writes a
    three-class ``rawPrediction`` (margins / log-scores, class order Negative,
    Neutral, Positive); labels follow SCR-1 (softmax, first max, threshold).
    The six models are applied one after another on the wide frame -- a
    narrow chain, no join back and no shuffle; each model's own output
    columns are dropped again after its margins are taken. A model sees the
    text of its gated rows only (an empty text elsewhere). Aspects without a
    model get ``Neutral`` (SCR-4); ungated aspects ``""``.

    ``shared`` is a pipeline that all models begin with (a tokeniser, features):
    it runs once on the text of the rows that any aspect gates, and the models
    read what it adds."""

    def __init__(self, models: dict, input_col: str = "text", raw_col: str = "rawPrediction",
                 threshold: float = CONFIDENCE_THRESHOLD, shared=None):
        self.models = dict(models)
        self.shared = shared
        self.input_col = input_col
        self.raw_col = raw_col
        self.threshold = threshold

    def apply(self, df: DataFrame, gates: dict[str, Column], text_col: str = "reviews") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        held = "_whole_text"
        if self.input_col != text_col and self.input_col in df.columns:
            raise ValueError(f"input column {self.input_col!r} already exists")
        out = df.withColumn(held, F.col(text_col))
        common = []
        if self.shared is not None:
            any_gate = reduce(lambda x, y: x | y, [F.coalesce(gates[a], F.lit(False)) for a in ASPECTS])
            out = out.withColumn(self.input_col, F.when(any_gate, F.col(held)).otherwise(F.lit("")))
            before = set(out.columns)
            out = self.shared.transform(out)
            common = [c for c in out.columns if c not in before]
        for a in ASPECTS:
            model = self.models.get(a)
            if model is None:
                out = out.withColumn(f"logits_{a}", F.lit(None).cast("array<double>"))
                continue
            if self.shared is None:
                out = out.withColumn(self.input_col, F.when(gates[a], F.col(held)).otherwise(F.lit("")))
            before = set(out.columns)
            scored = model.transform(out)
            added = [c for c in scored.columns if c not in before]
            out = (scored.withColumn(f"logits_{a}", F.when(gates[a], vector_to_array(F.col(self.raw_col))))
                   .drop(*added))
        out = out.drop(self.input_col, *common)
        if self.input_col == text_col or text_col not in out.columns:
            out = out.withColumn(text_col, F.col(held))
        out = out.drop(held)
        for a in ASPECTS:
            label = (label_from_logits(f"logits_{a}", self.threshold) if a in self.models
                     else F.lit("Neutral"))
            out = out.withColumn(a, F.when(gates[a], label).otherwise(F.lit("")))
        return out


def sentiment_map() -> Column:
    """SCR-5: six aspects -> label (``""`` when not mentioned)."""
    return F.create_map(*[x for a in ASPECTS for x in (F.lit(a), F.col(a))])


def predict(reviews: DataFrame, scorer=None, text_col: str = "reviews", engine: str | None = None) -> DataFrame:
    """SCR-6: per review, six aspect labels and the ``sentiment`` map.

    Gate = substring match of the ``api`` lexicon on the lower-cased text;
    only gated aspects are scored. All narrow -- no shuffle."""
    from ..plans.flow import score_reviews
    out = score_reviews(reviews, scorer, text_col, keep_features=False, engine=engine)
    return out.drop(*[f"logits_{a}" for a in ASPECTS if f"logits_{a}" in out.columns])


def sentiment_long(scored: DataFrame, keys=("review_id",)) -> DataFrame:
    """Long form of a scored frame: one row per gated (review, aspect)."""
    entries = F.array(*[F.struct(F.lit(i).alias("aspect_ord"), F.lit(a).alias("aspect"),
                                 F.col(a).alias("sentiment"),
                                 (F.col(f"logits_{a}") if f"logits_{a}" in scored.columns
                                  else F.lit(None).cast("array<double>")).alias("logits"))
                        for i, a in enumerate(ASPECTS)])
    return (scored.select(*keys, F.inline(F.filter(entries, lambda s: s["sentiment"] != F.lit("")))))
