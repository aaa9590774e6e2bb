import collections
import random
import re
import zlib

import numpy as np
import pytest

from revlens.llm import spelling as S


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        near = [o for o in counts if one_edit(w, o)]
        best = min(near, key=lambda o: (-counts[o], o)) if near else None
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)
    full = {}
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        full[w] = (form, root, n, k, m)
    return full


def some_words(rng, letters, low, high, count):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(count)})


def test_scan_against_all_pairs():
    rng = random.Random(1)
    for _ in range(150):
        a, b = some_words(rng, "abé", 1, 7, rng.randint(1, 60)), some_words(rng, "abé", 3, 9, 30)
        words, block = a + b, np.array([0] * len(a) + [1] * len(b))
        i, j = S.scan(words, block)
        got = list(zip(i.tolist(), j.tolist()))
        assert len(got) == len(set(got))
        assert set(got) == {(x, y) for x in range(len(words)) for y in range(x + 1, len(words))
                            if block[x] == block[y] and one_edit(words[x], words[y])}


@pytest.mark.parametrize("limit", [2, 20, 1024])
def test_groups_against_brute_force(spark, limit):
    """Blocks split down to single positions give the same groups."""
    rng = random.Random(2)
    words = some_words(rng, "abcÿ", 3, 8, 400) + ["z" * 3000, "z" * 3001, "z" * 2999 + "y"]
    counts = {w: rng.choice([2, 3, 30, 300, 3000]) for w in words}
    got = S.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), limit=limit).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute(counts)
    assert len(got) == len(counts)


def test_long_chains_have_one_root(spark):
    words = [f"chain{'x' * k}" for k in range(15)]
    counts = {w: 10**k for k, w in enumerate(words)}
    got = S.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r.root for r in got} == {words[-1]}


def plain_vocabulary(rows, noise=31):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def test_vocabulary(spark, documents, texts, odd, none):
    got = {r.word: r.n for r in S.vocabulary(documents, noise=31).collect()}
    assert got == plain_vocabulary(texts.items())
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] + [(2**53 + 1, "Straße ÉLÉMENT élément ÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷ abcdefgh Abcdefgh")]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    assert {r.word: r.n for r in S.vocabulary(df, noise=31).collect()} == plain_vocabulary(rows)
    assert S.group_variants(S.vocabulary(none, noise=31)).count() == 0
