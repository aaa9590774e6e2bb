"""Quality classifier: supervised subword embeddings.

Every word, word pair and character n-gram (3 and 4 bytes) of a text is hashed
to a row of a learned embedding table. A document is the average of its word
vectors plus the average of its n-gram vectors, and a softmax over two classes
gives its score. Tables and output layer are trained together by minibatch
stochastic gradient descent in numpy, on a bounded sample of labelled rows
(``MAX_TRAIN_ROWS`` per class), inside one Spark task.

A word pair of two equal words is hashed to one shared row (a back reference),
so that repetition is visible whatever the word.

Because the output layer is linear in the averaged vectors, scoring folds each
table row and the output layer into one number beforehand; the score is exactly
the softmax of the averaged vectors.

Defined results: a null or empty text has no features and gets the softmax of
the bias, i.e. about the share of label 1; with no usable labels of either kind
every score is ``default_score``; an empty table gives no rows; repeated rows
are scored one by one; labels that name a document more than once count by
their smallest value; texts are read whole whatever their length.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held_out, make_room, mix, release, safe_text, slices, staged, utf8, word_hashes

# Documented bound of the training sample, per class. Which labelled rows enter
# depends on a hash of doc_id only.
MAX_TRAIN_ROWS = 1000
BITS = 16
DIM = 8
_REP = np.uint64(0x5DEECE66D)


def _features(buf: np.ndarray):
    """(start, row) of word features and of n-gram features of a byte array;
    rows 0..2^BITS-1 are words, the next 2^BITS are n-grams."""
    at, h = word_hashes(buf)
    shift = np.uint64(64 - BITS)
    same = h[1:] == h[:-1]
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * np.uint64(3) + h[1:])
    pair[same] = mix(_REP[None])[0]
    b = buf.astype(np.uint32)
    grams = []
    with np.errstate(over="ignore"):
        code = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16)) if len(b) > 2 else b[:0]
        grams.append(((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32))
        code = code[:-1] | (b[3:] << np.uint32(24)) if len(b) > 3 else b[:0]
        grams.append((((code ^ np.uint32(0x7F4A7C15)) * np.uint32(2246822519)) >> np.uint32(32 - BITS)).astype(np.int32))
    return at, (h >> shift).astype(np.int32), (pair >> shift).astype(np.int32), grams


def _range_sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    lo = np.minimum(lo, len(values))  # a text without features may start behind the last one
    return c[np.minimum(np.maximum(lo, hi), len(values))] - c[lo]


def _spans(spans):
    a = np.array([(s, e) for _, s, e in spans], np.int64)
    return np.array([i for i, _, _ in spans], np.int64), a[:, 0], a[:, 1]


def logits(texts, word_value: np.ndarray, gram_value: np.ndarray) -> np.ndarray:
    """Logit of each text without bias; value arrays hold one number per row."""
    enc = utf8(texts)
    sums = np.zeros((len(enc), 4))  # word sum, word count, n-gram sum, n-gram count
    for buf, spans in slices(enc):
        i, s, e = _spans(spans)
        at, h, pair, grams = _features(buf)
        lo, hi = np.searchsorted(at, s), np.searchsorted(at, e)
        pairs = np.maximum(hi - lo - 1, 0)
        np.add.at(sums[:, 0], i, _range_sums(word_value[h], lo, hi))
        np.add.at(sums[:, 0], i, _range_sums(word_value[pair], lo, lo + pairs))
        np.add.at(sums[:, 1], i, hi - lo + pairs)
        for n, g in zip((3, 4), grams):
            end = np.maximum(e - n + 1, s)
            s0, e0 = np.minimum(s, len(g)), np.minimum(end, len(g))
            np.add.at(sums[:, 2], i, _range_sums(gram_value[g], s0, e0))
            np.add.at(sums[:, 3], i, e0 - s0)
    return sums[:, 0] / np.maximum(sums[:, 1], 1) + sums[:, 2] / np.maximum(sums[:, 3], 1)


def _sparse(texts):
    """Rows and weights of each text: weights of a family sum to 1."""
    rows, weights, ptr = [], [], [0]
    for t in utf8(texts):
        words, grams = [], []
        for buf, spans in slices([t]):
            e = spans[0][2]
            at, h, pair, gs = _features(buf)
            words += [h, pair]
            grams += [g[:max(e - n + 1, 0)] for n, g in zip((3, 4), gs)]
        n = 0
        for fam, base in ((words, 0), (grams, 1 << BITS)):
            f = np.concatenate(fam) if fam else np.zeros(0, np.int32)
            if len(f):
                u, c = np.unique(f, return_counts=True)
                rows.append(u + base)
                weights.append((c / len(f)).astype(np.float32))
                n += len(u)
        ptr.append(ptr[-1] + n)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.array(ptr)
    # One after the other: the parts of the first are gone before the second is joined.
    joined = np.concatenate(rows)
    rows.clear()
    return joined, np.concatenate(weights), np.array(ptr)


def train(texts, labels, base_rate: float | None = None, epochs: int | None = None, lr: float = 0.5, batch: int = 32, seed: int = 7) -> dict:
    """Minibatch SGD. Each row's step is scaled by its gradient history
    (AdaGrad), without which rare rows would hardly move. The class weights
    restore ``base_rate`` (share of label 1) when the sample is balanced. A
    small sample is gone over more often (about 6,000 texts in all)."""
    epochs = epochs or min(max(3, -(-6000 // max(len(labels), 1))), 30)
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    rows, w, ptr = _sparse(texts)
    emb = rng.normal(0, 0.3, (2 << BITS, DIM)).astype(np.float32) / DIM
    out = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    he, ho, hb = np.full((2 << BITS, 1), 1e-8, np.float32), np.full_like(out, 1e-6), np.full_like(bias, 1e-6)
    share = y.mean()
    base = share if base_rate is None else base_rate
    cw = np.array([(1 - base) / max(1 - share, 1e-9), base / max(share, 1e-9)], np.float32)
    for epoch in range(epochs):
        step = lr * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            docs = order[k:k + batch]
            docs = docs[ptr[docs + 1] > ptr[docs]]
            if not len(docs):
                continue
            sel = np.concatenate([np.arange(ptr[d], ptr[d + 1]) for d in docs])
            size = ptr[docs + 1] - ptr[docs]
            at = np.cumsum(size) - size
            r, v = rows[sel], w[sel]
            vec = np.add.reduceat(emb[r] * v[:, None], at)
            z = vec @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p
            g[np.arange(len(docs)), y[docs]] -= 1
            g *= cw[y[docs]][:, None] / len(docs)
            gv = np.repeat(g @ out.T, size, 0) * v[:, None]
            u, inv = np.unique(r, return_inverse=True)
            ge = np.zeros((len(u), DIM), np.float32)
            np.add.at(ge, inv, gv)
            he[u] += (ge ** 2).mean(1, keepdims=True)
            emb[u] -= step * ge / np.sqrt(he[u]) * 0.1
            go, gb = vec.T @ g, g.sum(0)
            ho += go ** 2
            hb += gb ** 2
            out -= step * 0.1 * go / np.sqrt(ho)
            bias -= step * 0.1 * gb / np.sqrt(hb)
    value = emb @ (out[:, 1] - out[:, 0])
    return {"word": value[:1 << BITS].astype(np.float32), "gram": value[1 << BITS:].astype(np.float32),
            "bias": float(bias[1] - bias[0])}


def _dump(model: dict) -> bytes:
    buf = io.BytesIO()
    np.savez_compressed(buf, **model)
    return buf.getvalue()


def _load(blob: bytes) -> dict:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> tuple[DataFrame, float | None]:
    """At most ``max_rows`` labelled, not held-out documents of ``docs`` of each
    class, by a hash of doc_id, as (doc_id, text, y); and the share of label 1
    among all usable labels of ``docs`` (None if a class is missing). Labels of
    documents that are not in ``docs`` take no part."""
    lab = (labels.select("doc_id", F.col(label).cast("int").alias("y"))
           .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
           .groupBy("doc_id").agg(F.min("y").alias("y")))
    # Narrow rows, read three times below.
    lab = staged(lab.join(docs.select("doc_id"), "doc_id", "left_semi"), "labels")
    row = lab.agg(F.count("y").alias("n"), F.sum("y").alias("ones")).first()
    n, ones = row["n"], row["ones"] or 0
    if not n or ones in (0, n):
        return docs.select("doc_id", safe_text().alias("text"), F.lit(0).alias("y")).limit(0), None
    parts = [lab.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for k in (0, 1)]
    # At most 2 * max_rows narrow rows: bounded, so the broadcast is too.
    pick = F.broadcast(parts[0].unionByName(parts[1]))
    got = (docs.select("doc_id", safe_text().alias("text")).join(pick, "doc_id")
           .groupBy("doc_id", "y").agg(F.min("text").alias("text")))
    return got, ones / n


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> dict | None:
    """Train in one task on the bounded sample; None without both classes."""
    sample, base = labelled_sample(docs, labels, label, max_rows)
    if base is None:
        return None

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        make_room()
        pdf = pdf.sort_values("doc_id")
        if pdf["y"].nunique() < 2:
            return pd.DataFrame({"model": pd.Series([], dtype=object)})
        blob = _dump(train(list(pdf["text"]), pdf["y"].to_numpy(), base))
        release()
        return pd.DataFrame({"model": [blob]})

    got = sample.withColumn("model", F.lit("m")).groupBy("model").applyInPandas(one, "model binary").collect()  # one row of bounded size
    return _load(got[0]["model"]) if got else None


def score(docs: DataFrame, model: dict | None, default_score: float = 1.0, threshold: float = 0.7,
          keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (and the ``keep`` columns) per row."""
    spark = docs.sparkSession
    bound_batches(spark)
    extra = [F.col(c) for c in keep or []]
    if model is None:
        s = F.lit(float(default_score))
    else:
        shared = spark.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def quality_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            make_room()
            m = shared.value
            for text in batches:
                yield pd.Series(1 / (1 + np.exp(-(logits(list(text), m["word"], m["gram"]) + float(m["bias"])))))
            release()

        s = quality_score(safe_text())
    return (docs.select("doc_id", held_out().alias("held_out"), s.alias("score"), *extra)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    return score(docs, fit(docs, labels), threshold=threshold)


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (all columns) that the classifier accepts."""
    cols = docs.columns
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), "doc_id", "text")
    kept = score(named, fit(docs, labels), threshold=threshold, keep=["row"])
    return kept.where(F.col("predicted") == 1).select("row.*")
