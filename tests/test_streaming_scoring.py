"""Streaming equals batch; scorer interface."""
import json

import numpy as np

from revlens.functions.lexicons import ASPECTS
from revlens.operators import rollup, scoring
from revlens.plans import flow
from revlens.streaming import stream

from conftest import frame

TEXTS = ["The nurses were kind", "The Doctor was rude; doctors ok", "Clean ICU, room access was slow",
         "Hospitals nearby are cheap", "Bad service, worst staff", "nothing to see", None]


def land(tmp_path, rows, name="in"):
    d = tmp_path / name
    d.mkdir()
    for i, chunk in enumerate([rows[:3], rows[3:]]):
        (d / f"part{i}.json").write_text("\n".join(json.dumps({"review_id": r[0], "batch": r[1], "reviews": r[2]})
                                                   for r in chunk))
    return str(d)


def test_prediction_stream_equals_batch(spark, tmp_path):
    rows = [(i, "h%d" % (i % 2), t) for i, t in enumerate(TEXTS)]
    src = land(tmp_path, rows)
    sink = str(tmp_path / "out")
    q = stream.start_prediction_query(spark, src, sink, checkpoint=str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(sink).select("review_id", *ASPECTS).collect())
    df = spark.createDataFrame(rows, "review_id long, batch string, reviews string")
    exp = sorted(tuple(r) for r in flow.score_reviews(flow.drop_null_reviews(df), keep_features=False)
                 .select("review_id", *ASPECTS).collect())
    assert got == exp


def test_rollup_stream_equals_batch(spark, tmp_path):
    rows = [(i, "h%d" % (i % 2), t) for i, t in enumerate(TEXTS)]
    src = land(tmp_path, rows)
    table = str(tmp_path / "rollup")
    q = stream.start_rollup_query(spark, src, table, checkpoint=str(tmp_path / "ck2"), available_now=True)
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in stream.current_rollup(spark, table).collect())
    df = spark.createDataFrame(rows, "review_id long, batch string, reviews string")
    scored = flow.score_reviews(flow.drop_null_reviews(df), keep_features=False)
    exp = sorted(tuple(r) for r in rollup.aspect_rollup(scored).collect())
    assert got == exp


def test_model_scorer_interface(spark):
    def load():
        # A stand-in model: longer texts lean positive; doctor model missing -> Neutral.
        def fn(texts):
            return np.array([[0.0, 0.5, len(t) / 10.0] for t in texts])
        return {a: fn for a in ASPECTS if a != "doctor"}

    df = frame(spark, ["The Doctor was rude; doctors ok", "rs"])
    out = {r["review_id"]: r for r in flow.score_reviews(df, scorer=scoring.ModelScorer(load),
                                                          keep_features=False).collect()}
    assert out[0]["doctor"] == "Neutral" and out[0]["staff"] == "Positive"
    assert out[1]["cost"] == "Neutral" and out[1]["staff"] == ""


def test_linear_scorer_truncation(spark):
    df = frame(spark, ["doctor " + "filler " * 600 + "rude"])
    full = flow.score_reviews(df, keep_features=False).collect()[0]
    cut = flow.score_reviews(df, scorer=scoring.LinearScorer(max_tokens=512), keep_features=False).collect()[0]
    assert full["doctor"] == "Negative" and cut["doctor"] == "Neutral"


def test_pipeline_scorer_matches_model_predictions(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, Tokenizer

    from revlens.functions.lexicons import ASPECTS, SENTIMENT_LABELS
    from revlens.operators import scoring
    from revlens.plans import flow

    train = spark.createDataFrame(
        [("rude doctor terrible", 0.0), ("dirty and slow", 0.0), ("ok average visit", 1.0),
         ("nothing special", 1.0), ("kind nurses excellent", 2.0), ("great clean rooms", 2.0)] * 3,
        "text string, label double")
    model = Pipeline(stages=[Tokenizer(inputCol="text", outputCol="words"),
                             HashingTF(inputCol="words", outputCol="tf", numFeatures=64),
                             LogisticRegression(featuresCol="tf", maxIter=30, family="multinomial")]).fit(train)
    rows = ["The Doctor was rude; doctors ok", "The nurses were kind", "Clean ICU, room access was slow",
            "Hospitals nearby are cheap", ""]
    df = spark.createDataFrame([(i, "b", r) for i, r in enumerate(rows)], "review_id long, batch string, reviews string")
    scorer = scoring.PipelineScorer({"doctor": model, "staff": model, "cleanliness": model})
    got = {r["review_id"]: r for r in flow.score_reviews(df, scorer, keep_features=False).collect()}
    gated = {r["review_id"]: r for r in flow.score_reviews(df, keep_features=False).collect()}
    preds = {r["review_id"]: SENTIMENT_LABELS[int(r["prediction"])]
             for r in model.transform(df.withColumnRenamed("reviews", "text")).collect()}
    for rid in range(len(rows)):
        for a in ASPECTS:
            is_gated = gated[rid][a] != ""
            if not is_gated:
                assert got[rid][a] == ""
            elif a in ("doctor", "staff", "cleanliness"):
                assert got[rid][a] == preds[rid]
            else:
                assert got[rid][a] == "Neutral"
    assert "text" not in flow.score_reviews(df, scorer, keep_features=False).columns


def test_rollup_stream_upserts_changed_groups(spark, tmp_path):
    """Every trigger writes the groups it changed; readers see the newest."""
    src = tmp_path / "grow"
    src.mkdir()
    table = str(tmp_path / "rollup2")
    seen = []
    for n, rows in enumerate([[(0, "a", "The nurses were kind"), (1, "b", "The doctor was rude")],
                              [(2, "a", "Rude nurses")]]):
        (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("review_id", "batch", "reviews"), r))) for r in rows))
        seen += rows
        stream.start_rollup_query(spark, str(src), table, available_now=True).awaitTermination(120)
    last = spark.read.parquet(table)
    newest = last.agg({"epoch": "max"}).first()[0]
    assert {r.batch for r in last.where(f"epoch = {newest}").collect()} == {"a"}
    scored = flow.score_reviews(spark.createDataFrame(seen, "review_id long, batch string, reviews string"), keep_features=False)
    assert (sorted(map(tuple, stream.current_rollup(spark, table).collect()))
            == sorted(map(tuple, rollup.aspect_rollup(scored).collect())))


def test_streams_have_checkpoints_of_their_own(spark):
    a = stream._checkpoint(spark, "predict", "s1", "t", None)
    assert a != stream._checkpoint(spark, "predict", "s2", "t", None) != stream._checkpoint(spark, "rollup", "s2", "t", None)
    assert stream._checkpoint(spark, "predict", "s", "t", "given") == "given"


def test_models_load_once_per_worker(spark, tmp_path):
    from revlens.functions.lexicons import ASPECTS
    from revlens.operators import scoring

    log = str(tmp_path / "loads")

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return {a: (lambda texts: [[0.0, 0.0, float(len(texts) <= scoring.MODEL_BATCH)] for _ in texts]) for a in ASPECTS}

    df = spark.createDataFrame([(i, "b", "The doctor was kind") for i in range(640)], "review_id long, batch string, reviews string")
    out = flow.score_reviews(df.repartition(32, "review_id"), scoring.ModelScorer(load), keep_features=False)
    assert {r.doctor for r in out.select("doctor").collect()} == {"Positive"}
    pids = open(log).read().split()
    assert len(pids) == len(set(pids)) <= 32


def test_large_weight_table_is_joined(spark, monkeypatch):
    from revlens.functions.lexicons import ASPECTS
    from revlens.operators import scoring

    df = spark.createDataFrame([(i, "b", t) for i, t in enumerate(TEXTS + TEXTS[:2])], "review_id long, batch string, reviews string")
    df = flow.drop_null_reviews(df)
    for words in (None, 4):
        cols = ["review_id", *ASPECTS, *[f"logits_{a}" for a in ASPECTS]]
        small = flow.score_reviews(df, scoring.LinearScorer(max_tokens=words), keep_features=False).select(*cols)
        want = sorted(map(str, small.collect()))
        monkeypatch.setattr(scoring, "MAX_LITERAL_WEIGHTS", 3)
        large = flow.score_reviews(df, scoring.LinearScorer(max_tokens=words), keep_features=False).select(*cols)
        assert sorted(map(str, large.collect())) == want
        monkeypatch.undo()
