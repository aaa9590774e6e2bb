"""Differential and property tests: Spark expressions vs plain-Python
restatements written from the spec, on random and fixture text."""
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revlens.functions.lexicons import (API_LEXICON, APP_LEXICON, ASPECTS, JSON_LEXICON,
                                        all_keywords, reduce_for_substring)
from revlens.operators import masking, spam, tagging
from revlens.operators import matcher
from revlens.operators.matcher import KeywordScanner
from revlens.plans import flow

from conftest import frame

WORDS = ["doctor", "doctors", "nurse", "staff", "rs", "room", "access", "wi-fi", "air", "conditioning",
         "clean", "slow", "é", "ñandú", "x_y", "hospital", "hospitals", "icu", "bad", "service", "worst",
         "rude", "good", "great", "a", "b", "c", "Dr.", "ENT", "check-in", "out-of-pocket", "123", "rs5"]
SEPS = [" ", "  ", ", ", ". ", "; ", "-", "\t", "\n", " ", " ", "\x1c", "/", "'"]


def rand_text(rng, n):
    out = []
    for _ in range(n):
        w = rng.choice(WORDS)
        out.append(w.upper() if rng.random() < 0.1 else w)
        out.append(rng.choice(SEPS))
    return "".join(out)


def is_word_char(ch):
    return ch == "_" or unicodedata.category(ch)[0] in ("L", "N")


def py_word_hit(low, kw):
    # whole-word occurrence: neighbours are not word characters
    start = low.find(kw)
    while start >= 0:
        end = start + len(kw)
        if (start == 0 or not is_word_char(low[start - 1])) and (end == len(low) or not is_word_char(low[end])):
            return True
        start = low.find(kw, start + 1)
    return False


def py_first_mask(low, kws):
    for kw in kws:
        start = low.find(kw)
        while start >= 0:
            end = start + len(kw)
            if (start == 0 or not is_word_char(low[start - 1])) and (end == len(low) or not is_word_char(low[end])):
                return low[:start] + "$T$" + low[end:]
            start = low.find(kw, start + 1)
    return None


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return [rand_text(rng, rng.randint(0, 25)) for _ in range(300)]


@pytest.mark.parametrize("engine", ["automaton", "jvm"])
def test_tags_gates_masks_match_python(spark, texts, engine):
    df = frame(spark, texts)
    sc = flow.score_reviews(df, engine=engine)
    rows = {r["review_id"]: r for r in sc.collect()}
    for i, t in enumerate(texts):
        low = t.lower()
        r = rows[i]
        for a in ASPECTS:
            gated = any(k in low for k in API_LEXICON[a])
            assert (r[a] != "") == gated, (t, a)
        hits = set(r["_hits"])
        for k in all_keywords():
            assert (k in hits) == py_word_hit(low, k), (t, k)
    masked = {(m["review_id"], m["Aspect"]): m["Formatted Review"] for m in masking.masked_rows(sc).collect()}
    for i, t in enumerate(texts):
        low = t.lower()
        for a in ASPECTS:
            if rows[i][a] == "":
                continue
            exp = py_first_mask(low, list(dict.fromkeys(APP_LEXICON[a])))
            assert masked.get((i, a)) == exp, (t, a)


def test_tag_order_matches_python(spark, texts):
    df = frame(spark, texts)
    rows = {r["review_id"]: r for r in tagging.tag_aspects(df).collect()}
    for i, t in enumerate(texts):
        low = t.lower()
        exp = [(a, k) for a, kws in JSON_LEXICON.items() for k in kws if py_word_hit(low, k)]
        assert list(zip(rows[i]["Aspects"], rows[i]["Matched Keywords"])) == exp


@given(st.lists(st.sampled_from(["a", "b", "c", "d", "ab", "x"]), max_size=12))
@settings(max_examples=40, deadline=None)
def test_reduction_keeps_any(words):
    text = "".join(words)
    for a in ASPECTS:
        kws = API_LEXICON[a]
        assert any(k in text for k in kws) == any(k in text for k in reduce_for_substring(kws))


def test_reduction_on_lexicons():
    rng = random.Random(3)
    for _ in range(200):
        text = rand_text(rng, 10).lower()
        for a in ASPECTS:
            assert any(k in text for k in API_LEXICON[a]) == any(k in text for k in reduce_for_substring(API_LEXICON[a]))


def exact_mean_jaccard(reviews):
    sets = [set(r.split()) for r in reviews]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    if not pairs:
        return 0.0
    tot = 0.0
    for i, j in pairs:
        u = sets[i] | sets[j]
        tot += len(sets[i] & sets[j]) / len(u) if u else 0.0
    return tot / len(pairs)


def test_bounds_and_estimate_vs_brute_force(spark):
    rng = random.Random(11)
    batches = {}
    vocab = ["w%d" % i for i in range(30)]
    for b in range(6):
        n = rng.randint(0, 25)
        base = rng.sample(vocab, 8)
        rows = []
        for _ in range(n):
            k = rng.randint(0, 10)
            toks = [rng.choice(base if rng.random() < 0.7 else vocab) for _ in range(k)]
            rows.append(" ".join(toks))
        if b == 5:
            rows = ["same set here"] * 12 + ["same set"] * 3
        batches[f"b{b}"] = rows
    data = [(i, b, r) for b, rows in batches.items() for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "review_id long, batch string, reviews string")
    stats = spam.review_token_stats(df)
    bounds = {r["batch"]: r for r in spam.jaccard_bounds(stats).collect()}
    est = {r["batch"]: r for r in spam.jaccard_estimate(stats, 256).collect()}
    ttr = {r["batch"]: r for r in spam.batch_ttr(stats).collect()}
    for b, rows in batches.items():
        if not rows:
            continue
        exact = exact_mean_jaccard(rows)
        lo, hi = bounds[b]["jaccard_lo"], bounds[b]["jaccard_hi"]
        assert lo - 1e-12 <= exact <= hi + 1e-12
        assert abs(est[b]["jaccard_est"] - exact) < 0.08
        py_ttr = sum(len(set(r.split())) / len(r.split()) if r.split() else 0 for r in rows) / len(rows)
        assert ttr[b]["avg_ttr"] == pytest.approx(round(py_ttr, 3), abs=1e-9)


def test_pair_bounds_vs_brute_force(spark):
    rng = random.Random(23)
    vocab = list("abcdefgh")
    batches = {}
    for b in range(12):
        base = set(rng.sample(vocab, rng.randint(1, 5)))
        rows = []
        for _ in range(rng.randint(2, 14)):
            s = set(base)
            if rng.random() < 0.5 and len(s) > 1:
                s.discard(rng.choice(sorted(s)))
            if rng.random() < 0.4:
                s.add(rng.choice(vocab))
            if rng.random() < 0.1:
                s = set()
            rows.append(" ".join(sorted(s)))
        batches[f"b{b}"] = rows
    data = [(i, b, r) for b, rows in batches.items() for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "review_id long, batch string, reviews string")
    got = {r["batch"]: r for r in spam.pair_bounds(spam.review_token_stats(df)).collect()}
    for b, rows in batches.items():
        exact = exact_mean_jaccard(rows)
        assert got[b]["n"] == len(rows)
        assert got[b]["pair_lo"] - 1e-12 <= exact <= got[b]["pair_hi"] + 1e-12


def test_gate_decisions_consistent(spark):
    rows = ["great " * 10 + "hospital"] * 20 + ["some other review text entirely different words"]
    df = spark.createDataFrame([(i, "s", r) for i, r in enumerate(rows)], "review_id long, batch string, reviews string")
    g_all = spam.spam_gate(df, all_bounds=True).collect()[0]
    g_und = spam.spam_gate(df).collect()[0]
    assert g_all["is_spam"] == g_und["is_spam"]
    exact = exact_mean_jaccard(rows)
    # the gate reports bounds rounded to 6 decimals
    assert g_all["jaccard_lo"] - 1e-6 <= exact <= g_all["jaccard_hi"] + 1e-6


def test_partition_invariance(spark, texts):
    df = frame(spark, texts)
    a = sorted(map(tuple, flow.score_reviews(df.repartition(1), keep_features=False)
                   .select("review_id", *ASPECTS).collect()))
    b = sorted(map(tuple, flow.score_reviews(df.repartition(7), keep_features=False)
                   .select("review_id", *ASPECTS).collect()))
    assert a == b


def test_scanner_boundaries(spark):
    sc = KeywordScanner([["rs"]], ["rs", "wi-fi", "doc"], matcher.word_class(spark))
    assert sc.scan("nurses") == (1, [], [])
    assert sc.scan("rs,wi-fi") == (1, ["rs", "wi-fi"], [0, 3])
    assert sc.scan("édoc doc_x doc doc") == (0, ["doc"], [11])


def test_both_engines_agree_on_every_code_point(spark):
    """A keyword next to each code point: hit or no hit, the same in both."""
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(k, "".join(f"{chr(c)}icu{chr(c)} " if c != 32 else "icu " for c in points[k:k + 1]))
                                for k in range(0, len(points), 1) if points[k] < 0x3000 or points[k] % 37 == 0 or
                                0x1E000 <= points[k] < 0x1F000], "review_id long, reviews string")
    hits = {}
    for engine in ("automaton", "jvm"):
        out = tagging.with_text_features(df, "reviews", ["icu"], engine=engine)
        hits[engine] = {r.review_id: sorted(r._hits) for r in out.select("review_id", tagging.HITS).collect()}
    assert hits["automaton"] == hits["jvm"]


_set_lists = st.lists(st.lists(st.sampled_from(list("abcdef")), max_size=5), min_size=1, max_size=12)


@settings(max_examples=25, deadline=None)
@given(batches=st.lists(_set_lists, min_size=1, max_size=3))
def test_all_exact_bounds_bracket_the_mean(spark, batches):
    rows = [(i, f"b{b}", " ".join(toks)) for b, sets in enumerate(batches) for i, toks in enumerate(sets)]
    df = spark.createDataFrame(rows, "review_id long, batch string, reviews string")
    stats = spam.review_token_stats(df)
    first = {r["batch"]: r for r in spam.jaccard_bounds(stats).collect()}
    pair = {r["batch"]: r for r in spam.pair_bounds(stats).collect()}
    for b, sets in enumerate(batches):
        exact = exact_mean_jaccard([" ".join(t) for t in sets])
        f, p = first[f"b{b}"], pair[f"b{b}"]
        assert f["jaccard_lo"] - 1e-9 <= exact <= f["jaccard_hi"] + 1e-9
        assert p["pair_lo"] - 1e-9 <= exact <= p["pair_hi"] + 1e-9


def test_gate_partition_invariance(spark):
    rng = random.Random(3)
    rows = []
    for b in range(4):
        base = ["w%d" % rng.randrange(6) for _ in range(4)]
        for i in range(15):
            toks = [t for t in base if rng.random() < 0.8] * 5
            rows.append((b * 100 + i, f"b{b}", " ".join(toks)))
    df = spark.createDataFrame(rows, "review_id long, batch string, reviews string")
    a = sorted(map(tuple, spam.spam_gate(df.repartition(1), all_bounds=True).collect()))
    b = sorted(map(tuple, spam.spam_gate(df.repartition(7), all_bounds=True).collect()))
    assert a == b
