"""Models fitted per aspect (SCR-2(b)): a multinomial naive Bayes for each of them.

Texts are split into words once; the features are word counts over one vocabulary
for all aspects, written once, and every aspect's model is fitted from that table (a
sum per class, combined in the map tasks). Models are saved under a folder, one per aspect, as pipelines that
take the text itself; :func:`scorer` applies them with the words counted once.

To the rows of each aspect comes one empty text per class, so that a class without
rows keeps its place in the model. An aspect without rows gets no model (SCR-4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import ASPECTS, SENTIMENT_LABELS
from ..session import staging_path
from . import lexicon_join, scoring

# Words of the vocabulary: the most frequent ones, ties in code-point order.
VOCABULARY = 4096
INPUT, WORDS, FEATURES = "text", "_words", "_features"


def vocabulary(rows: DataFrame, text_col: str = "reviews", size: int = VOCABULARY) -> list[str]:
    """The ``size`` most frequent words of all texts."""
    return _most_frequent(rows, lexicon_join.words_of(text_col), size)


def _most_frequent(rows: DataFrame, words: Column, size: int) -> list[str]:
    found = rows.select(F.explode_outer(words).alias("word")).where("word is not null")
    top = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r["word"] for r in top.collect()]  # at most ``size`` rows


def _splitter():
    from pyspark.ml.feature import SQLTransformer

    return SQLTransformer(statement=f"SELECT *, filter(split(lower({INPUT}), r'{T.NON_WORD_RUN}'), w -> w <> '') AS {WORDS} FROM __THIS__")


def fit(labelled: DataFrame, text_col: str = "reviews", size: int = VOCABULARY, smoothing: float = 1.0) -> dict:
    """One fitted pipeline per aspect. ``labelled`` has a label column per aspect;
    an empty or NULL label or a NULL text is no training row."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import CountVectorizerModel

    spark = labelled.sparkSession
    rows = labelled.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias(INPUT), *ASPECTS)
    path, splitter = staging_path(spark, "labelled"), _splitter()
    splitter.transform(rows).select(WORDS, *ASPECTS).write.parquet(path)
    rows = spark.read.parquet(path)
    vocab = _most_frequent(rows, F.col(WORDS), size)
    if not vocab:
        return {}
    counter = CountVectorizerModel.from_vocabulary(vocab, inputCol=WORDS, outputCol=FEATURES)
    features = staging_path(spark, "features")
    empty = spark.createDataFrame([([], *[k] * len(ASPECTS)) for k in SENTIMENT_LABELS], rows.schema)
    counter.transform(rows.unionByName(empty)).select(FEATURES, *ASPECTS).write.parquet(features)
    table = spark.read.parquet(features)
    seen = rows.agg(*[F.count_if(F.col(a) != F.lit("")).alias(a) for a in ASPECTS]).first()
    classes = F.array(*[F.lit(k) for k in SENTIMENT_LABELS])
    bayes = NaiveBayes(featuresCol=FEATURES, labelCol="_label", modelType="multinomial", smoothing=smoothing)
    models = {}
    for a in ASPECTS:
        if seen[a]:
            train = table.select(FEATURES, (F.array_position(classes, F.col(a)) - 1).cast("double").alias("_label")).where("_label >= 0")
            models[a] = PipelineModel(stages=[splitter, counter, bayes.fit(train)])
    return models


def save(models: dict, folder: str) -> None:
    for a, m in models.items():
        m.write().overwrite().save(f"{folder}/{ASPECTS.index(a)}")


def load(spark: SparkSession, folder: str) -> dict:
    """The saved models of a folder; aspects without one are left out."""
    from pyspark.ml import PipelineModel

    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    found = {}
    for i, a in enumerate(ASPECTS):
        at = fs_path(f"{folder}/{i}")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            found[a] = PipelineModel.load(f"{folder}/{i}")
    return found


def scorer(models: dict) -> scoring.PipelineScorer:
    """A scorer of models fitted together: what they share runs once a review."""
    from pyspark.ml import PipelineModel

    shared = PipelineModel(stages=next(iter(models.values())).stages[:-1]) if models else None
    return scoring.PipelineScorer({a: m.stages[-1] for a, m in models.items()}, input_col=INPUT, shared=shared)
