import random
import re

import numpy as np
import pytest

from revlens.llm import substrings as S


def brute(ids, texts, width):
    """Mask of removed words of every document, by the rule as it is written."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    order = [(i is None, i or 0) for i in ids]
    least = {}
    for o, ws in zip(order, words):
        for a in range(len(ws) - width + 1):
            key = tuple(ws[a:a + width])
            least[key] = min(least.get(key, o), o)
    out = []
    for o, ws in zip(order, words):
        gone = [False] * len(ws)
        for a in range(len(ws) - width + 1):
            if least[tuple(ws[a:a + width])] < o:
                gone[a:a + width] = [True] * width
        out.append(gone)
    return words, out


def copied_texts(rng, count, letters="abc"):
    texts = []
    for _ in range(count):
        w = []
        if texts and rng.random() < .6:
            w = rng.choice(texts).split()
            a = rng.randrange(len(w) + 1)
            w = w[a:a + rng.randint(0, 12)]
        texts.append(" ".join([rng.choice(letters) for _ in range(rng.randint(0, 6))] + w + [rng.choice(letters) for _ in range(rng.randint(0, 6))]))
    return texts


def test_shard_against_brute_force():
    """Any split into lower shards and one's own gives the same spans."""
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 12)
        ids = sorted(rng.sample(range(100), n))
        if n > 2 and rng.random() < .3:
            ids[1] = ids[0]
        if rng.random() < .4:
            ids += [None, None]
        texts = copied_texts(rng, len(ids))
        k = rng.randrange(len(ids))
        while k and ids[k] == ids[k - 1]:
            k -= 1
        below = [S.window_hashes([t.encode()], 4)[0] for t in texts[:k]]
        elsewhere = np.unique(np.concatenate(below)) if below else np.zeros(0, np.uint64)
        got = S.shard_spans(ids[k:], [t.encode() for t in texts[k:]], elsewhere, 4)
        assert [g.tolist() for _, g in got] == brute(ids, texts, 4)[1][k:]


def test_window_hashes_are_equal_for_equal_words():
    h = S.window_hashes([b"a b c d e", b"x\ta  b\nc", b"", b"a b"], 3)
    assert [len(x) for x in h] == [3, 2, 0, 0]
    assert h[0][0] == h[1][1] and len(set(h[0].tolist() + h[1].tolist())) == 4


@pytest.mark.parametrize("shard_chars", [300, 4_000_000])
def test_whole_job_against_brute_force(spark, shard_chars):
    """Many shards, one id with a third of all rows, nulls and ids above 2**53."""
    rng = random.Random(4)
    texts = copied_texts(rng, 240)
    ids = [2**53 + 1 + k for k in range(120)] + [77] * 80 + [None] * 40
    rng.shuffle(ids)
    rows = [(i, t, "x", -1) for i, t in zip(ids, texts)]
    out = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int"), 4, shard_chars).collect()
    words, gone = brute(ids, texts, 4)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    want = sorted(((i, len(w), sum(g), " ".join(x for x, y in zip(w, g) if not y)) for i, w, g in zip(ids, words, gone)), key=key)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out), key=key) == want
    assert all(r.n_removed == sum(b - a for a, b in zip(r.starts, r.stops)) for r in out)


def test_odd_rows(odd, none):
    out = S.substring_dedup(odd).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[8].n_removed == by[8].n_words and by[8].kept == "" and by[7].n_removed == 0
    assert by[2].n_words == by[3].n_words == by[4].n_words == 0
    assert by[9].kept == "x" * 70_000
    assert S.substring_dedup(none).count() == 0
