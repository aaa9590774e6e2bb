import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import quality, toxicity
from revlens.llm.common import load

SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger(spark):
    docs = load(spark, SF001, "documents")
    return docs, load(spark, SF001, "labels")


def accuracy(out, labels, label):
    rows = out.join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").where("held_out").collect()
    return np.mean([r.predicted == r.y for r in rows])


def test_quality_held_out_accuracy(larger):
    docs, labels = larger
    out = quality.classify(docs, labels).cache()
    assert out.count() == docs.count()
    assert accuracy(out, labels, "quality") > 0.9
    for r in out.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_toxicity_held_out_accuracy(larger):
    docs, labels = larger
    out = toxicity.classify(docs, labels)
    assert accuracy(out, labels, "toxic") > 0.8


def test_toxicity_trains_five_pairs(spark, documents, labels):
    model = toxicity.fit(documents, labels)
    assert len(model["members"]) == 5 and len(model["w"]) == 5 * 6 + 1


def test_labels_of_absent_documents_take_no_part(spark, documents, labels):
    """A stage before may have removed documents: the sample and the class share
    come from what is left, so removed positives don't silence the classifier."""
    lab = labels.where("toxic in (0, 1)")
    first = (lab.where("toxic = 1").select("doc_id", F.xxhash64("doc_id").alias("h")).join(documents.select("doc_id"), "doc_id")
             .orderBy("h").limit(3).select("doc_id"))
    left = documents.join(first, "doc_id", "left_anti")
    sample, share = quality.labelled_sample(left, lab, "toxic", 3)
    got = sample.collect()
    assert {r.y for r in got} == {0, 1} and sum(r.y for r in got) == 3
    usable = left.join(lab, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    assert share == pytest.approx(usable.agg(F.avg("toxic")).first()[0])
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    assert {r.doc_id for r in got} <= ids


def test_held_out_labels_are_not_used(spark, documents, labels):
    """Flipping held-out labels changes nothing."""
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    a, b = quality.fit(documents, labels), quality.fit(documents, flipped)
    assert (a is None) == (b is None)
    if a is not None:
        assert (a["word"] == b["word"]).all() and float(a["bias"]) == float(b["bias"])


def test_score_equals_averaged_vectors():
    """Folded scoring is the softmax of averaged vectors, for cut texts too."""
    rng = np.random.default_rng(1)
    word, gram = rng.normal(size=1 << quality.BITS).astype(np.float32), rng.normal(size=1 << quality.BITS).astype(np.float32)
    texts = ["one two two three", "", "x", "été à la " * 50, None, "ab"]
    got = quality.logits(texts, word, gram)
    for t, v in zip(texts, got):
        rows, w, ptr = quality._sparse([t])
        value = np.concatenate([word, gram])
        assert abs((value[rows] * w).sum() - v) < 1e-4


@pytest.mark.parametrize("op, default", [(quality, 1.0), (toxicity, 0.0)])
def test_odd_rows(spark, odd, none, op, default):
    words = ["good words here", "bad!! BAD!! words"]
    lab = spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 3, 5, 6, 9, 10, 11, 13)] + [(1, 1, 1), (None, 1, 0), (99, 1, 1)],
                                "doc_id long, quality int, toxic int")
    out = op.classify(odd, lab).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (2, 3)}) == 1  # null and empty text alike
    assert op.classify(none, lab).count() == 0
    # No labels of one kind: the default score, and nothing is rejected.
    for few in (lab.limit(0), lab.where("quality = 1 AND toxic = 1")):
        assert {r.score for r in op.classify(odd, few).collect()} == {default}
        assert op.drop_rejected(odd, few).count() == odd.count()
    assert op.drop_rejected(odd, lab).columns == odd.columns
    assert words


def test_dictionaries_explain_their_own_side():
    toxic = [toxicity.windows("some words and a dreadfulslur here " + str(k)) for k in range(200)]
    plain = [toxicity.windows("some words and a pleasant thing here " + str(k)) for k in range(200)]
    m = toxicity.train_member(toxic, plain, 0)
    comp = toxicity.compressors_of([m])
    ct, co = comp[0]
    d = toxicity.differences(ct, co, [b"and a dreadfulslur", b"and a pleasant thing"])
    assert d[0] > d[1]
    s = toxicity.batch_statistics([m], comp, ["a dreadfulslur", "", None])
    assert s.shape == (3, 6) and not s[1].any() and not s[2].any()


def test_windows_cover_the_text():
    for t in ("", "a", "x" * 500, "word " * 100, "é" * 300):
        assert b"".join(toxicity.windows(t)) == t.lower().encode()
