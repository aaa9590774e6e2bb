"""Hand-computed golden cases (FIXTURES.md §3)."""
import pytest
from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.functions.lexicons import ASPECTS, aspect_key
from revlens.operators import masking, rollup, scoring, spam, tagging
from revlens.plans import flow

from conftest import frame

GOLDEN = [
    ("The nurses were kind", {"staff", "cost"}, [("Staff Behaviour", "nurses")],
     {"staff": "the $T$ were kind"}),
    ("The Doctor was rude; doctors ok", {"doctor", "staff", "cost"},
     [("Doctor Behaviour", "doctors"), ("Doctor Behaviour", "doctor")],
     {"doctor": "the doctor was rude; $T$ ok", "staff": "the doctor was $T$; doctors ok"}),
    ("Clean ICU, room access was slow", {"staff", "cleanliness", "waitingtime", "facility"},
     [("Cleanliness", "clean"), ("Waiting time", "slow"), ("Facility Experience", "room")],
     {"staff": "clean $T$, room access was slow", "cleanliness": "$T$ icu, room access was slow",
      "waitingtime": "clean icu, room access was $T$", "facility": "clean $T$, room access was slow"}),
    ("Hospitals nearby are cheap", {"cost", "facility"}, [("Cost", "cheap")],
     {"cost": "hospitals nearby are $T$"}),
    ("Wi-Fi and air conditioning broke", {"facility"},
     [("Facility Experience", "air conditioning"), ("Facility Experience", "wi-fi")],
     {"facility": "wi-fi and $T$ broke"}),
    ("Bad service, worst staff", {"staff", "cost", "facility"},
     [("Staff Behaviour", "staff"), ("Facility Experience", "service")],
     {"staff": "bad service, worst $T$", "facility": "bad $T$, worst staff"}),
    ("édoc mdé", {"doctor"}, [], {}),
    ("", set(), [], {}),
]


@pytest.fixture(scope="module", params=["automaton", "jvm"])
def scored(spark, request):
    df = frame(spark, [g[0] for g in GOLDEN])
    return flow.score_reviews(df, engine=request.param).orderBy("review_id").collect(), request.param


def test_gates(scored):
    rows, _ = scored
    for row, (_, gated, _, _) in zip(rows, GOLDEN):
        assert {a for a in ASPECTS if row[a] != ""} == gated


def test_tags(spark):
    df = frame(spark, [g[0] for g in GOLDEN])
    rows = tagging.tag_aspects(df).orderBy("review_id").collect()
    for row, (_, _, tags, _) in zip(rows, GOLDEN):
        assert list(zip(row["Aspects"], row["Matched Keywords"])) == tags


def test_masks(spark, scored):
    _, engine = scored
    df = frame(spark, [g[0] for g in GOLDEN])
    sc = flow.score_reviews(df, engine=engine)
    got = {}
    for r in masking.masked_rows(sc).collect():
        got.setdefault(r["review_id"], {})[r["Aspect"]] = r["Formatted Review"]
    for i, (_, _, _, masks) in enumerate(GOLDEN):
        assert got.get(i, {}) == masks


@pytest.mark.parametrize("text,expected", [("good good good good good", 0.2), ("Good good", 1.0), ("", 0.0)])
def test_ttr(spark, text, expected):
    st = spam.review_token_stats(frame(spark, [text])).collect()[0]
    assert st["ttr"] == pytest.approx(expected)


def test_jaccard_scalar(spark):
    df = spark.createDataFrame([("a b c", "b c d"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(T.jaccard(T.ws_tokens("a"), T.ws_tokens("b"))).collect()]
    assert got == [0.5, 0.0]


def test_batch_jaccard_small(spark):
    one = spam.spam_gate(frame(spark, ["a b"])).collect()[0]
    assert one["avg_jaccard"] == 0.0 and one["n"] == 1


def test_gate_thresholds_inclusive(spark):
    """Both thresholds hold at equality, through the gate itself."""
    same = [" ".join(["a"] * 5)] * 6                       # TTR 0.2, mean Jaccard 1
    above = [" ".join(["a"] * 4)] * 6                      # TTR 0.25
    # 10 reviews, 9 equal and one apart: mean Jaccard 36/45 = 0.8 exactly.
    at = [" ".join(["a"] * 5)] * 9 + [" ".join(["b"] * 5)]
    # 8 equal and two apart: 28/45, below.
    below = [" ".join(["a"] * 5)] * 8 + [" ".join(["b"] * 5), " ".join(["c"] * 5)]
    got = {}
    for name, rows in {"same": same, "above": above, "at": at, "below": below}.items():
        got[name] = spam.spam_gate(frame(spark, rows, batch=name)).collect()[0]
    assert got["same"]["is_spam"] and got["same"]["avg_ttr"] == 0.2 and got["same"]["avg_jaccard"] == 1.0
    assert not got["above"]["is_spam"] and got["above"]["decided_by"] == "ttr"
    assert got["at"]["is_spam"] and got["at"]["decided_by"] == "lower_bound"
    assert not got["below"]["is_spam"]


def test_spam_batch_flagged(spark):
    rows = ["great " * 10 + "hospital"] * 9 + ["great " * 10 + "hospital extra"]
    g = spam.spam_gate(frame(spark, rows, batch="s")).collect()[0]
    assert g["is_spam"] and g["decided_by"] == "lower_bound"


def _rollup_one(spark, labels, neutral="drop"):
    df = spark.createDataFrame([(i, "b", l) for i, l in enumerate(labels)], "review_id long, batch string, doctor string")
    for a in ASPECTS[1:]:
        df = df.withColumn(a, F.lit(""))
    return rollup.aspect_rollup(df, ("batch",), neutral).where("Aspect = 'doctor'").collect()[0]


def test_rollup_cases(spark):
    r = _rollup_one(spark, ["Positive", "Positive", "Negative", "Neutral", ""])
    assert (r["Positive"], r["Neutral"], r["Negative"], r["Sentiment"]) == (66.66666666666666, 0.0, 33.33333333333333,
                                                                            "66.66666666666666")
    r = _rollup_one(spark, ["Positive", "Positive", "Negative", "Neutral", ""], neutral="count")
    assert (r["Positive"], r["Neutral"], r["Negative"], r["Sentiment"]) == (50.0, 25.0, 25.0, "50.0")
    assert _rollup_one(spark, ["Negative"])["Sentiment"] == "-100.0"
    assert _rollup_one(spark, ["Positive", "Negative"])["Sentiment"] == "50.0"
    assert _rollup_one(spark, ["Neutral", ""])["Sentiment"] == "0.0"


def test_rollup_complete_rows(spark):
    df = frame(spark, ["nothing here at all"]).withColumn("doctor", F.lit(""))
    for a in ASPECTS[1:]:
        df = df.withColumn(a, F.lit(""))
    out = rollup.aspect_rollup(df).orderBy("aspect_ord").collect()
    assert [r["Aspect"] for r in out] == ASPECTS and all(r["Sentiment"] == "0.0" for r in out)


def test_labels(spark):
    df = spark.createDataFrame([([0.1, 2.0, -1.0],), ([1.0, 1.0, 0.0],)], "l array<double>")
    assert [r[0] for r in df.select(scoring.label_from_logits("l")).collect()] == ["Neutral", "Negative"]


def test_aspect_key(spark):
    assert aspect_key("Waiting time") == "waitingtime"
    df = spark.createDataFrame([("Waiting time",), ("Doctor Behaviour",)], "a string")
    assert [r[0] for r in df.select(T.aspect_key_col("a")).collect()] == ["waitingtime", "doctorbehaviour"]


def test_literal_map(spark):
    df = spark.createDataFrame([("{'doctor': 'Positive'}",), ("oops",), (None,), ("{'doctor': None}",)], "s string")
    got = [r[0] for r in df.select(F.size(T.parse_map_literal("s"))).collect()]
    assert got == [1, 0, 0, 1]


def test_url_key(spark):
    from urllib.parse import quote
    samples = ["a/b~c*d+e", "St. Mary's Hospital, Pune", "Hôpital & Clinic #1?x=1", "100% ok"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r[0] for r in df.select(T.url_key("s")).collect()] == [quote(s) for s in samples]


def test_one_decimal_is_python_format(spark):
    from revlens.operators.rollup import one_decimal

    values = [s * k / 2000 * 100 for k in range(2001) for s in (1, -1)] + [a / b * 100 for b in range(1, 60) for a in range(b)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", one_decimal("v").alias("s"))
    assert all(r.s == format(r.v, ".1f") or (r.v == 0 and r.s == "0.0") for r in df.collect())


def test_map_literals(spark):
    import ast

    from revlens.functions import text as T

    literals = ["{'a': None, 'b': 'x'}", "{'x: None}': 'y', 'k': 'v: None}'}", "{1: 'a', 'b': True, 'c': 2.5}",
                '{"a": "it\'s", \'b\': \'q"q\'}', "['a']", "{}", "{'a': 'it\\'s'}", "{'p': 'a, b: c', 'q': ''}"]
    df = spark.createDataFrame([(x,) for x in literals + ["oops"]], "x string").select("x", T.parse_map_literal("x").alias("m"))
    for r in df.collect():
        want = {} if r.x == "oops" else ast.literal_eval(r.x)
        want = {str(k): v if isinstance(v, str) else None for k, v in want.items()} if isinstance(want, dict) else {}
        assert r.m == want
