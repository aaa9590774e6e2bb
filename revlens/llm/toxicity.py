"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.
A text is cut into windows of about ``WINDOW`` bytes at white space; each window
is compressed with both dictionaries, and the difference of the two compressed
lengths says how much better the toxic dictionary explains it. Thresholds on
these differences (their log odds in toxic against ordinary training documents)
and a logistic layer on a document's window statistics are calibrated on the
training sample and give the score.

How the dictionaries are made comparable: both end in one shared dictionary
trained on ordinary text and differ only in the part before it, so a window
without anything specific to either side compresses to the same length with
both. Training is repeated a few rounds: windows of toxic documents that the
toxic dictionary explains better become its next training text, and windows of
ordinary documents that it wrongly explains better become the next training
text of the ordinary one. ``MEMBERS`` pairs are trained on different halves of
the ordinary windows, each in a task of its own, and their statistics are used
together.

Training reads a bounded sample of labelled rows (``MAX_TRAIN_ROWS`` per class,
chosen by a hash of doc_id among the labelled rows of the table at hand). Members
and logistic layer are fitted on the same rows: layers calibrated on rows that the
members had not seen kept fewer toxic documents out (README). A dictionary is
trained on at most ``MAX_WINDOWS`` ordinary windows, and on none below 8 bytes (the
library takes no shorter samples). Scoring compresses every window of every text.

Defined results: a null or empty text gets the calibrated score of a text in
which nothing stands out; without usable labels of both kinds every score is
``default_score``; an empty table gives no rows; repeated rows are scored one
by one. A window without white space is cut at WINDOW bytes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held_out, make_room, release, safe_text
from .quality import labelled_sample

MAX_TRAIN_ROWS = 2500
WINDOW = 64
MEMBERS = 5
LEVEL = 5
MIN_MATCH = 5
BASE_BYTES = 98304
# Size of the differing part in each training round.
ROUNDS = (16384, 12288)
SEGMENT = 12
LOW, HIGH = -10, 14
# Ordinary documents whose windows are compared in training (a part of the
# sample; the rest only feeds the dictionaries).
CONTRAST_DOCS = 1500
# Ordinary windows that one dictionary is trained on, drawn from the sample.
MAX_WINDOWS = 80_000


def windows(text: str | None) -> list[bytes]:
    b = (text or "").lower().encode("utf-8", "surrogatepass")
    out, s, n = [], 0, len(b)
    while s < n:
        e = s + WINDOW
        if e < n:
            k = b.rfind(b" ", s, e)
            e = k if k > s else e
        out.append(b[s:e])
        s = e
    return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Trained dictionary of at most ``size`` bytes; when there is too little
    text to train on, the text itself."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zs.train_dictionary(size, samples, k=SEGMENT, d=6, level=3).as_bytes()
    except (zs.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _compressor(content: bytes) -> zs.ZstdCompressor:
    params = zs.ZstdCompressionParameters.from_level(
        LEVEL, source_size=WINDOW, dict_size=len(content), write_content_size=0, write_checksum=0,
        write_dict_id=0, min_match=MIN_MATCH)
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=d, compression_params=params)


def differences(toxic: zs.ZstdCompressor, ordinary: zs.ZstdCompressor, ws: list[bytes]) -> np.ndarray:
    return _lengths(ordinary, ws) - _lengths(toxic, ws)


def _lengths(c: zs.ZstdCompressor, ws: list[bytes]) -> np.ndarray:
    compress = c.compress
    return np.fromiter((len(compress(w)) for w in ws), np.int64, len(ws))


def _odds(table: np.ndarray, d: np.ndarray) -> np.ndarray:
    return table[np.clip(d, LOW, HIGH) - LOW]


def statistics(table: np.ndarray, d: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Window statistics of several documents, one row each: ``d`` are the
    length differences of all their windows, ``size`` the windows per document
    (a document without windows gets zeros)."""
    out = np.zeros((len(size), 6))
    full = np.flatnonzero(size)
    if not len(full):
        return out
    n = size[full]
    end = np.cumsum(n)
    at = end - n
    o = _odds(table, d)
    ranked = o[np.lexsort((o, np.repeat(np.arange(len(n)), n)))]
    hits = np.add.reduceat((d >= 3).astype(np.int64), at)
    out[full] = np.c_[np.log1p(1000 * np.add.reduceat(o, at) / n), ranked[end - 1] + np.where(n > 1, ranked[end - 2], 0),
                      np.log1p(200 * hits / n), np.log1p(hits), np.log(n),
                      np.log1p(100 * np.maximum(np.add.reduceat(d, at) / n, 0))]
    return out


def train_member(toxic: list[list[bytes]], ordinary: list[list[bytes]], seed: int) -> dict:
    """One pair of dictionaries and its table of log odds."""
    rng = np.random.default_rng(seed)
    mine = [w for ws in toxic for w in ws]
    plain = [w for ws in ordinary for w in ws]
    order = rng.permutation(len(plain))
    half = [plain[i] for i in order[:len(order) // 2]]
    rest = [plain[i] for i in order[len(order) // 2:]]
    base = _dictionary(half[:MAX_WINDOWS], BASE_BYTES)
    contrast = [ordinary[i] for i in rng.permutation(len(ordinary))[:CONTRAST_DOCS]]
    theirs = rest[:MAX_WINDOWS]
    table = np.zeros(HIGH - LOW + 1)
    front_t = front_o = b""
    for size in ROUNDS:
        if len(mine) < 50 and front_t:
            break
        front_t = _dictionary([mine[i] for i in rng.permutation(len(mine))], size)
        front_o = _dictionary([theirs[i] for i in rng.permutation(len(theirs))], size) if len(theirs) > 200 else front_o
        ct, co = _compressor(front_t + base), _compressor(front_o + base)
        dt = [differences(ct, co, ws) for ws in toxic]
        do = [differences(ct, co, ws) for ws in contrast]
        share = [np.bincount(np.clip(np.concatenate(x or [np.zeros(0, np.int64)]), LOW, HIGH) - LOW, minlength=len(table)) for x in (dt, do)]
        share = [x / max(x.sum(), 1) for x in share]
        table = np.maximum(np.log((share[0] + 1e-5) / (share[1] + 1e-5)), 0)
        mine = [w for ws, d in zip(toxic, dt) for w, v in zip(ws, d) if v >= 2]
        theirs = [w for ws, d in zip(contrast, do) for w, v in zip(ws, d) if v >= 2]
    return {"toxic": front_t + base, "ordinary": front_o + base, "table": table}


def batch_statistics(members: list[dict], compressors: list, texts) -> np.ndarray:
    """Statistics of all members for some texts, one row per text. One member
    after the other goes over all windows, so that its dictionary stays in the
    processor's cache."""
    out = []
    for run in _runs(texts):
        ws = [windows(t) for t in run]
        size = np.array([len(w) for w in ws], np.int64)
        flat = [w for x in ws for w in x]
        out.append(np.hstack([statistics(m["table"], differences(ct, co, flat), size)
                              for m, (ct, co) in zip(members, compressors)]))
    return np.concatenate(out) if out else np.zeros((0, 6 * len(members)))


def _runs(texts, limit: int = 4 << 20):
    """Consecutive texts of about ``limit`` characters together."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t or "")
        if n >= limit:
            yield run
            run, n = [], 0
    if run:
        yield run


def compressors_of(members: list[dict]) -> list:
    return [(_compressor(m["toxic"]), _compressor(m["ordinary"])) for m in members]


def calibrate(stats: np.ndarray, y: np.ndarray, base: float) -> dict:
    """Logistic layer on the statistics (Newton steps, small ridge), weighted
    so that the sample stands for a share ``base`` of toxic documents."""
    share = y.mean()
    sw = np.where(y == 1, base / share, (1 - base) / (1 - share))
    mu, sd = stats.mean(0), stats.std(0) + 1e-6
    z = np.c_[(stats - mu) / sd, np.ones(len(stats))]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (sw * (p - y)) + 1e-1 * w
        h = (z.T * (sw * p * (1 - p))) @ z + 1e-1 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return {"mu": mu, "sd": sd, "w": w}


def probability(cal: dict, stats: np.ndarray) -> np.ndarray:
    z = np.c_[(stats - cal["mu"]) / cal["sd"], np.ones(len(stats))] @ cal["w"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAIN_ROWS) -> dict | None:
    """Members are trained side by side, one task each, on the bounded sample;
    the logistic layer is calibrated on the same rows, in tasks that share them.
    A member's task cuts its rows into windows batch by batch and keeps the
    windows only, not the texts. None without labels of both kinds."""
    sample, base = labelled_sample(docs, labels, label, max_rows)
    if base is None:
        return None

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make_room()
        seed, rows = 0, []
        for pdf in batches:
            seed = int(pdf["member"].iloc[0])
            rows += [(i, y, windows(t)) for i, y, t in zip(pdf["doc_id"].tolist(), pdf["y"].tolist(), pdf["text"])]
            del pdf
        rows.sort(key=lambda r: r[0])  # no id twice in the sample
        model = train_member([w for _, y, w in rows if y == 1], [w for _, y, w in rows if y == 0], seed)
        del rows
        release()
        yield pd.DataFrame({"member": [seed], "model": [pickle.dumps(model)]})

    bound_batches(docs.sparkSession)
    fitted = (sample.withColumn("member", F.explode(F.array(*[F.lit(k) for k in range(MEMBERS)])))
              .groupBy("member").applyInPandas(one, "member int, model binary"))
    members = [pickle.loads(r["model"]) for r in sorted(fitted.collect(), key=lambda r: r["member"])]
    if not members:
        return None
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(members)

    def stats(batches):
        make_room()
        m = shared.value
        comp = compressors_of(m)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"],
                                "stats": list(batch_statistics(m, comp, pdf["text"]))})
        del comp
        release()

    rows = (sample.repartition(8, "doc_id").mapInPandas(stats, "doc_id long, y int, stats array<double>")
            .orderBy("doc_id").collect())  # at most 2 * max_rows short rows
    y = np.array([r["y"] for r in rows])
    if len(set(y)) < 2:
        return None
    return {"members": members, **calibrate(np.array([r["stats"] for r in rows]), y, base)}


def score(docs: DataFrame, model: dict | None, default_score: float = 0.0, threshold: float = 0.3,
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
        def toxicity_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            make_room()
            m = shared.value
            comp = compressors_of(m["members"])
            for text in batches:
                yield pd.Series(probability(m, batch_statistics(m["members"], comp, text)), dtype="float64")
            del comp
            release()

        s = toxicity_score(safe_text())
    return (docs.select("doc_id", held_out().alias("held_out"), s.alias("score"), *extra)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    return score(docs, fit(docs, labels), threshold=threshold)


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (all columns) that are not scored toxic."""
    cols = docs.columns
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), "doc_id", "text")
    kept = score(named, fit(docs, labels), threshold=threshold, keep=["row"])
    return kept.where(F.col("predicted") == 0).select("row.*")
