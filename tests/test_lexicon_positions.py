"""Lexicons as data and dense positions."""
import random
import re

import pytest

from revlens.operators import lexicon_join, positions, spam, substring_join

TEXTS = ["Great Wi-Fi, great room", "wi fi", "the air conditioning unit", "air. Conditioning!", "", None, "room service room service", "éÉ à"]
LEXICON = [("a", "wi-fi"), ("a", "room"), ("b", "AIR conditioning"), ("b", "room service"), ("c", "É"), ("c", "éé"), ("d", "..."), ("d", "service room")]


def expected():
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    out = []
    for i, t in enumerate(TEXTS):
        w = words(t)
        for a, k in LEXICON:
            q = words(k)
            if q and any(w[p:p + len(q)] == q for p in range(len(w) - len(q) + 1)):
                out.append((i, a, k))
    return sorted(out)


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_lexicon_as_data(spark, monkeypatch, bound):
    """Broadcast and salted shuffle give the same matches."""
    monkeypatch.setattr(spam, "MAX_BROADCAST_BYTES", bound)
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "review_id long, reviews string")
    lex = spark.createDataFrame(LEXICON, "aspect string, keyword string")
    got = lexicon_join.match(texts, lex)
    assert sorted((r.review_id, r.aspect, r.keyword) for r in got.collect()) == expected()
    assert lexicon_join.match(texts, lex.limit(0)).count() == 0
    assert lexicon_join.match(texts.limit(0), lex).count() == 0


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_substrings_of_a_keyword_table(spark, monkeypatch, bound):
    """Broadcast and salted shuffle against ``in``: keywords shorter and longer than
    the run, of astral code points, at both ends of a text and over a piece's end."""
    monkeypatch.setattr(spam, "MAX_BROADCAST_BYTES", bound)
    monkeypatch.setattr(substring_join, "PIECE", 50)
    rng = random.Random(bound)
    texts = ["".join(rng.choice("abcé \U0001F600") for _ in range(rng.choice([0, 1, 5, 60, 400]))) for _ in range(60)] + ["", None, "ABC", texts_repeat := "ab" * 300]
    pool = "".join(t for t in texts if t)
    words = {pool[p:p + rng.randint(1, 30)] for p in rng.sample(range(len(pool)), 200)} | {texts_repeat, "", "zzzzzzz", "Abc", "abc"}
    lexicon = [(k % 3, w) for k, w in enumerate(sorted(words))] + [(0, "a"), (0, "a"), (None, "b"), (1, None)]
    df = spark.createDataFrame([(2**53 + 1 + i, t) for i, t in enumerate(texts)] + [(None, "null key abc")], "review_id long, reviews string").repartition(3)
    lex = spark.createDataFrame(lexicon, "aspect int, keyword string")
    got = sorted(map(repr, (tuple(r) for r in substring_join.match(df, lex).select("review_id", "aspect", "keyword").collect())))
    rows = [(2**53 + 1 + i, t) for i, t in enumerate(texts) if t is not None] + [(None, "null key abc")]
    assert got == sorted(repr((i, a, k)) for i, t in rows for a, k in set(lexicon) if k and k.lower() in t.lower())
    assert substring_join.match(df, lex.limit(0)).count() == 0
    assert substring_join.match(df.limit(0), lex).count() == 0
    with pytest.raises(ValueError):
        substring_join.match(df, lex.withColumnRenamed("aspect", "review_id"))


def test_positions_are_dense(spark):
    rng = random.Random(1)
    ids = rng.sample(range(-10**15, 10**15), 500)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, t string").repartition(7)
    a = positions.with_position(df, "id")
    assert [(r.position, r.id) for r in a.orderBy("position").collect()] == list(enumerate(sorted(ids)))
    b = positions.with_position(df.select("id", "t"), "id").select("position", "t")
    assert all(r.t == f"t{r.id}" for r in positions.attach(a.drop("t"), b).collect())
    with pytest.raises(ValueError):
        positions.attach(a, b.where("position > 0"))
    assert positions.with_position(df.limit(0), "id").count() == 0


def test_candidates_do_not_grow_with_keywords_that_share_runs(spark):
    """Keywords that agree but for their last words: what leaves the scan are the
    matches, not every keyword of a run."""
    lexicon = [(f"common run of words {i}x",) for i in range(2000)]
    texts = [(i, f"Common run of words {i}x" if i % 2 else "common run of words") for i in range(60)]
    lex = spark.createDataFrame(lexicon, "keyword string").withColumnRenamed("keyword", "_low")
    low = spark.createDataFrame([(i, t.lower()) for i, t in texts], "review_id long, _text string")
    made = substring_join.index(lex)
    rows = substring_join._scan(low, ["review_id"], made).collect()
    assert len(rows) < 60 + 30 and {(r.review_id, r["_low"]) for r in rows} >= {(i, t.lower()) for i, t in texts if i % 2}


def test_rows_that_repeat_their_keys_are_one_text(spark):
    rows = [(1, "abc abcdefgh"), (1, "abcdefgh"), (1, "other"), (2, "abcdefgh abcdefgh"), (None, "abc"), (None, "abc"), (3, None)]
    lex = spark.createDataFrame([("k", "abcdefgh"), ("k", "abc"), ("j", "ABC")], "aspect string, keyword string")
    got = [(r.review_id, r.aspect, r.keyword) for r in substring_join.match(spark.createDataFrame(rows, "review_id long, reviews string").repartition(3), lex).collect()]
    want = [(i, a, k) for i in (1, 2) for a, k in (("k", "abcdefgh"), ("k", "abc"), ("j", "ABC"))] + [(None, "k", "abc"), (None, "j", "ABC")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
