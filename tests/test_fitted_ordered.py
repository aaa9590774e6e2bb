"""Fitted models per aspect, ordered result files and the review limit on a stream."""
import json
import math
import random
import re
from collections import Counter

import pytest

from revlens.functions.lexicons import ASPECTS, SENTIMENT_LABELS
from revlens.operators import fitted
from revlens.sources import ordered
from revlens.streaming import stream

ROWS = [("good kind kind", "Positive", ""), ("bad rude", "Negative", ""), ("kind of rude, rude!", "Negative", "Neutral"), ("", "Positive", ""), (None, "Positive", "")]


def labelled(spark, rows):
    a, b = ASPECTS[:2]
    rest = ", ".join(f"`{x}` string" for x in ASPECTS[2:])
    return spark.createDataFrame([(*r, *[""] * (len(ASPECTS) - 2)) for r in rows], f"reviews string, `{a}` string, `{b}` string, {rest}")


def test_fitted_models_are_naive_bayes(spark, tmp_path):
    """Saved, loaded and compared with log sums in plain Python."""
    fitted.save(fitted.fit(labelled(spark, ROWS)), str(tmp_path))
    models = fitted.load(spark, str(tmp_path))
    assert list(models) == list(ASPECTS[:2])  # the others have no rows
    words = lambda t: re.findall(r"\w+", t.lower())
    vocab = {w for t, *_ in ROWS if t for w in words(t)}
    for j, a in enumerate(ASPECTS[:2]):
        data = [(t, r[j]) for t, *r in ROWS if t is not None and r[j]]
        text = "kind kind rude unseen"
        got = models[a].transform(spark.createDataFrame([(text,)], "text string")).first().rawPrediction
        for k, c in enumerate(SENTIMENT_LABELS):
            mine = [t for t, x in data if x == c]
            count = Counter(w for t in mine for w in words(t))
            want = math.log(len(mine) + 2) - math.log(len(data) + 6)
            want += sum(math.log(count[w] + 1) - math.log(sum(count.values()) + len(vocab)) for w in words(text) if w in vocab)
            assert abs(got[k] - want) < 1e-9


def test_nothing_to_fit(spark, tmp_path):
    assert fitted.fit(labelled(spark, [])) == {} and fitted.fit(labelled(spark, [("...", "Positive", "")])) == {}
    assert fitted.load(spark, str(tmp_path)) == {}
    rows = spark.createDataFrame([("b b a c",), ("a",)], "reviews string")
    assert fitted.vocabulary(rows, size=2) == ["a", "b"]


@pytest.mark.parametrize("hot,compression", [(False, "gzip"), (True, "none")])
def test_ordered_files(spark, tmp_path, hot, compression):
    rng = random.Random(3)
    rows = [(None if i % 50 == 0 else 7 if hot else rng.randrange(-10**12, 10**12), f'te"xt,\n {i}') for i in range(400)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(5)
    path = str(tmp_path / "out")
    manifest = ordered.write_ordered_csv(df, path, ["id"], ["t", "id"], parts=6, compression=compression).orderBy("file").collect()
    assert sum(m.n_rows for m in manifest) == 400 and len(manifest) > 3  # equal ids are split
    assert [m.first_row for m in manifest] == [sum(x.n_rows for x in manifest[:i]) for i in range(len(manifest))]
    got = sorted(ordered.read_ordered_csv(spark, path).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(400))
    keys = [(r.id is not None, int(r.id or 0)) for r in got]
    assert keys == sorted(keys) and Counter(r.t for r in got) == Counter(t for _, t in rows)
    empty = str(tmp_path / "empty")
    ordered.write_ordered_csv(df.limit(0), empty, ["id"], ["t"])
    assert ordered.read_ordered_csv(spark, empty).count() == 0


def test_rows_made_after_the_exchange_keep_the_order(spark, tmp_path):
    df = spark.createDataFrame([(i * 37 % 100,) for i in range(100)], "id long")
    twice = lambda rows: rows.selectExpr("id", "inline(filter(array(struct('a' AS k), struct('b' AS k)), s -> id % 5 > 0))")
    ordered.write_ordered_csv(df, str(tmp_path / "out"), ["id"], ["k", "id"], parts=5, expand=twice)
    got = sorted((r.position, int(r.id), r.k) for r in ordered.read_ordered_csv(spark, str(tmp_path / "out")).collect())
    assert got == [(n, i, k) for n, (i, k) in enumerate((i, k) for i in range(100) if i % 5 for k in "ab")]


def test_review_limit_on_a_stream(spark, tmp_path):
    """Ids in any order, repeated in a file and over files, and repeated epochs."""
    rng = random.Random(5)
    (tmp_path / "in").mkdir()
    ids = [(b, i) for b in ("x", "y", None) for i in range(40)]
    rng.shuffle(ids)
    for f in range(8):
        lines = [{"review_id": i, "batch": b, "reviews": f"r{i}"} for b, i in ids[f * 15:(f + 1) * 15] + ids[:3] + ids[:3]]
        lines += [{"review_id": -1, "batch": "x", "reviews": None}]
        (tmp_path / "in" / f"{f}.json").write_text("\n".join(map(json.dumps, lines)))
    table = str(tmp_path / "t")
    stream.start_limit_query(spark, str(tmp_path / "in"), table, checkpoint=str(tmp_path / "ck"), available_now=True, max_files_per_trigger=1, limit=10).awaitTermination(300)
    got = [(r.batch, r.review_id, r["rank"], r.reviews) for r in stream.current_first(spark, table, 10).collect()]
    assert Counter(got) == Counter((b, i, i + 1, f"r{i}") for b in ("x", "y", None) for i in range(10))


def test_shared_features_give_the_same_labels(spark):
    """The scorer that counts words once against one that runs whole pipelines."""
    from pyspark.sql import functions as F

    from revlens.operators import scoring

    models = fitted.fit(labelled(spark, ROWS))
    df = spark.createDataFrame([(1, "kind, kind"), (2, "rude unseen"), (3, "")], "review_id long, reviews string")
    gates = {a: F.col("review_id") != (2 if i else 3) for i, a in enumerate(ASPECTS)}
    one, each = (s.apply(df, gates).select("review_id", "reviews", *ASPECTS, *[f"logits_{a}" for a in ASPECTS[:2]]) for s in (fitted.scorer(models), scoring.PipelineScorer(models)))
    assert sorted(one.collect()) == sorted(each.collect())
    assert {r[a] for r in fitted.scorer({}).apply(df, gates).collect() for a in ASPECTS} == {"", "Neutral"}


def test_result_files_are_bounded(spark, tmp_path, monkeypatch):
    """One writing task, many files: no file, and so no reading task, grows with the
    rows of a task; the manifest keeps the order beyond three digits of file numbers."""
    from revlens.sources import reviews

    monkeypatch.setattr(reviews, "FILE_ROWS", 2)
    df = spark.range(0, 2300, 1, 3).selectExpr("id", "concat('a\n', id) AS t")
    path = str(tmp_path / "out")
    manifest = ordered.write_ordered_csv(df, path, ["id"], ["t", "id"], parts=1, compression="none").collect()
    assert len(manifest) == 1150 and max(m.n_rows for m in manifest) == 2
    got = [(r.position, int(r.id)) for r in ordered.read_ordered_csv(spark, path).collect()]
    assert sorted(got) == [(i, i) for i in range(2300)]


def test_arrow_batches_of_the_text_scan_are_bounded(spark):
    """What a worker holds at a time follows neither the rows of a task nor their length."""
    from pyspark.sql import functions as F

    from revlens import session
    from revlens.operators import matcher

    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: spark.conf.get(k) for k in keys}
    sizes = lambda batches: ([b.num_rows] for b in batches)

    def largest(rows):
        import pyarrow as pa

        def count(batches):
            for (n,) in sizes(batches):
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        return rows.mapInArrow(count, "n long").agg(F.max("n")).first()[0]

    try:
        for k, v in zip(keys, ("10000", str(64 << 20))):
            spark.conf.set(k, v)
        matcher.scan_column(spark, F.lit("x"), [["x"]], ["x"])
        assert largest(spark.range(0, 3000, 1, 1)) <= session.BATCH_ROWS
        wide = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
        assert largest(wide) * 100_000 <= 2 * session.BATCH_BYTES
        spark.conf.set(keys[0], "7")
        session.bound_batches(spark)
        assert spark.conf.get(keys[0]) == "7"  # a smaller setting stays
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
