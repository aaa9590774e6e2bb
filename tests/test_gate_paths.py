"""The spam gate's production path: bounds first, MinHash only for open
batches, and the flagged-batch anti join with a checked broadcast."""
import random

from revlens.operators import spam

from conftest import frame


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rep(tokens: str, k: int = 5) -> str:
    return " ".join(t for t in tokens.split() for _ in range(k))


def test_uniform_intersections_settled_by_pair_bound(spark):
    # TTR 0.2 everywhere; half the reviews are {a}, half {b}: identical-set
    # bound 2*C(5,2)/C(10,2) = 0.444 and size bound 1 leave it open; the
    # token-frequency bound is exact here (0.444) and settles it.
    rows = ["a a a a a"] * 5 + ["b b b b b"] * 5
    g = spam.spam_gate(frame(spark, rows, batch="o")).collect()[0]
    assert g["decided_by"] == "pair_upper_bound" and g["is_spam"] is False
    assert g["jaccard_hi"] == round(20 / 45, 6) and abs(g["avg_jaccard"] - 0.444) < 0.13


def test_open_batch_goes_through_estimate(spark):
    # Exact mean 0.861; best exact bounds 0.509 .. 0.869 -> only MinHash decides.
    sets = ["c f g h"] * 7 + ["c g h"] * 2 + ["c f h"]
    rows = [_rep(x) for x in sets]
    g = spam.spam_gate(frame(spark, rows, batch="o")).collect()[0]
    assert g["decided_by"] == "estimate"
    # avg_jaccard is rounded to 3 decimals, the bounds to 6
    assert g["jaccard_lo"] - 5e-4 <= g["avg_jaccard"] <= g["jaccard_hi"] + 5e-4
    assert abs(g["avg_jaccard"] - 0.861) < 0.08
    assert g["is_spam"] == (g["avg_jaccard"] >= 0.8)


def test_every_batch_reports_a_mean(spark):
    rows = ["great " * 10 + "hospital"] * 9 + ["great " * 10 + "hospital extra"]
    df = frame(spark, rows, batch="s").unionByName(frame(spark, ["a b c", "d e f"], batch="t"))
    got = {r["batch"]: r for r in spam.spam_gate(df).collect()}
    assert got["s"]["decided_by"] == "lower_bound" and got["s"]["is_spam"]
    assert got["t"]["decided_by"] == "ttr" and not got["t"]["is_spam"]
    for r in got.values():
        assert r["avg_jaccard"] is not None and r["jaccard_se"] >= 0 and not r["undecided"]
    short = {r["batch"]: r for r in spam.spam_gate(df, report=False).collect()}
    assert all(short[b]["is_spam"] == got[b]["is_spam"] and short[b]["avg_jaccard"] is None for b in got)


def test_standard_error_covers_the_exact_mean(spark):
    """Half {a,b,c,d}, half {a,b,c}: the error does not shrink with the batch,
    and the reported one says so."""
    for n in (30, 120):
        rows = [_rep("a b c d")] * (n // 2) + [_rep("a b c")] * (n // 2)
        stats = spam.review_token_stats(frame(spark, rows, batch="h"))
        exact = (2 * (n // 2) * (n // 2 - 1) / 2 + 0.75 * (n // 2) ** 2) / (n * (n - 1) / 2)
        r = spam.jaccard_estimate(spam.set_groups(stats), 64).collect()[0]
        assert abs(r["jaccard_est"] - exact) <= 4 * r["jaccard_se"] and 0.01 < r["jaccard_se"] < 0.06
        one_by_one = spam.jaccard_estimate(stats, 64).collect()[0]
        assert abs(one_by_one["jaccard_est"] - r["jaccard_est"]) < 1e-9


def exact_mean(rows):
    sets = [frozenset(r.split()) for r in rows]
    pairs = [(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    return sum(len(a & b) / len(a | b) if a | b else 0.0 for a, b in pairs) / len(pairs)


def test_sequential_verdicts_against_all_pairs(spark):
    """Batches that no bound settles: the looks end with the verdict of the exact
    mean, or the batch is undecided and says how sure it is."""
    rng = random.Random(5)
    batches = {f"b{k}": [_rep(" ".join(rng.sample("abcdef", rng.choice([4, 5, 5, 6])))) for _ in range(24)] for k in range(6)}
    batches["far"] = [_rep("c f g h")] * 14 + [_rep("c g h")] * 2
    batches["close"] = [_rep("a b c d")] * 7 + [_rep("a b c")] * 5  # 0.867
    batches["edge"] = [_rep("a b c d")] * 10 + [_rep("a b d")] * 6 + [_rep("a b")] * 2
    df = spark.createDataFrame([(1000 * i + k, b, r) for i, (b, rows) in enumerate(batches.items()) for k, r in enumerate(rows)],
                               "review_id long, batch string, reviews string")
    seen = set()
    for g in spam.spam_gate(df, report=False).collect():
        mean = exact_mean(batches[g["batch"]])
        seen.add(g["decided_by"])
        assert g["jaccard_lo"] - 1e-6 <= mean <= g["jaccard_hi"] + 1e-6
        if g["decided_by"] != "estimate":
            assert g["is_spam"] == (round(mean, 3) >= 0.8) and (g["n_hashes"], g["error"], g["undecided"]) == (0, 0.0, False)
            continue
        assert g["n_hashes"] in [spam.FAMILY << k for k in range(spam.LOOKS)]
        assert abs(g["avg_jaccard"] - mean) <= 4 * g["jaccard_se"] + 1e-3
        if g["undecided"]:
            assert g["n_hashes"] == spam.FAMILY << (spam.LOOKS - 1) and abs(mean - 0.8) < 8 * g["jaccard_se"] + 1e-3
            assert 0 < g["error"] <= 1
        else:
            assert g["is_spam"] == (round(mean, 3) >= 0.8) and g["error"] <= spam.ALPHA
    assert "estimate" in seen


def test_looks_add_hashes_only_where_needed(spark):
    """One clear batch and one at the threshold: only the second gets all looks."""
    clear = [_rep("c f g h")] * 7 + [_rep("c g h")] * 2 + [_rep("c f h")]
    edge = [_rep("a b c d")] * 4 + [_rep("a b c")] * 4 + [_rep("a b d")]
    rows = [(k, "clear", r) for k, r in enumerate(clear)] + [(100 + k, "edge", r) for k, r in enumerate(edge)]
    df = spark.createDataFrame(rows, "review_id long, batch string, reviews string")
    stats = spam.review_token_stats(df)
    mean = exact_mean(edge)
    open_ = spark.createDataFrame([("clear", 10, 0.0, 1.0), ("edge", 9, 0.0, 1.0)], "batch string, n long, jaccard_lo double, jaccard_hi double")
    got = {r["batch"]: r for r in spam.sequential_estimate(stats, open_, threshold=mean + 0.0005).collect()}
    assert got["edge"]["undecided"] and got["edge"]["n_hashes"] == spam.FAMILY << (spam.LOOKS - 1) and got["edge"]["error"] > 0.1
    assert not got["clear"]["undecided"] and got["clear"]["n_hashes"] < spam.FAMILY << (spam.LOOKS - 1)
    # The first look is the plain estimate with as many hashes.
    one = {r["batch"]: r for r in spam.sequential_estimate(stats, open_, looks=1).collect()}
    plain = {r["batch"]: r for r in spam.jaccard_estimate(stats, spam.FAMILY).collect()}
    assert all(abs(one[b]["jaccard_est"] - plain[b]["jaccard_est"]) < 1e-9 for b in one)


def test_token_sets_stay_out_of_exchanges(spark):
    """Bounds shuffle digests; signatures come from a review's own array."""
    stats = spam.review_token_stats(frame(spark, ["a b c", "a b", "d"], batch="x"))
    for df in (spam.bounds_from_sets(spam.set_keys(stats)), spam.jaccard_estimate(stats)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.split("\n") if "Exchange" in x]
        assert exchanges and not any("token_set" in x for x in exchanges)
        assert "first(token_set" not in plan


def test_seeded_batches_land_on_their_rungs(spark):
    from revlens.plans.derived import SEEDS

    df = None
    for k, (b, texts) in enumerate(SEEDS.items()):
        f = frame(spark, [texts[i % len(texts)] for i in range(40)], batch=b).selectExpr(f"review_id + {1000 * k} AS review_id", "batch", "reviews")
        df = f if df is None else df.unionByName(f)
    got = {r["batch"]: r["decided_by"] for r in spam.spam_gate(df).collect()}
    assert got == {"seed_same": "lower_bound", "seed_size": "upper_bound", "seed_split": "pair_upper_bound",
                   "seed_near": "pair_lower_bound", "seed_open": "estimate"}


def _mixed(spark):
    spam_rows = ["great " * 10 + "hospital"] * 10
    ok_rows = ["the nurses were kind", "clean rooms, slow check-in", "rude doctor"]
    return frame(spark, spam_rows, batch="s").unionByName(
        frame(spark, ok_rows, batch="t").selectExpr("review_id + 100 AS review_id", "batch", "reviews"))


def test_drop_spam_batches_broadcasts_small_list(spark):
    df = _mixed(spark)
    out = spam.drop_spam_batches(df, spam.spam_gate(df))
    assert sorted(r["review_id"] for r in out.collect()) == [100, 101, 102]
    plan = _plan(out)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_drop_spam_batches_nothing_flagged_no_join(spark):
    df = frame(spark, ["a b c", "d e f", "g h"], batch="t")
    out = spam.drop_spam_batches(df, spam.spam_gate(df))
    assert out.count() == 3
    assert "Join" not in _plan(out)


def test_drop_spam_batches_shuffle_fallback(spark, monkeypatch):
    monkeypatch.setattr(spam, "MAX_BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = _mixed(spark)
        out = spam.drop_spam_batches(df, spam.spam_gate(df))
        assert sorted(r["review_id"] for r in out.collect()) == [100, 101, 102]
        assert "BroadcastHashJoin" not in _plan(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_both_modes_share_the_decision_ladder(spark):
    fixtures = {
        "u": ["a a a a a"] * 5 + ["b b b b b"] * 5,
        "o": [_rep(x) for x in ["c f g h"] * 7 + ["c g h"] * 2 + ["c f h"]],
        "s": ["great " * 10 + "hospital"] * 9 + ["great " * 10 + "hospital extra"],
        "t": ["a b c", "d e f"],
    }
    df = None
    for b, rows in fixtures.items():
        f = frame(spark, rows, batch=b)
        df = f if df is None else df.unionByName(f)
    und = {r["batch"]: r for r in spam.spam_gate(df).collect()}
    alls = {r["batch"]: r for r in spam.spam_gate(df, all_bounds=True).collect()}
    for b in fixtures:
        assert und[b]["decided_by"] == alls[b]["decided_by"]
        assert und[b]["is_spam"] == alls[b]["is_spam"]
    assert alls["u"]["decided_by"] == "pair_upper_bound"


def test_counts_of_a_huge_batch_do_not_overflow(spark):
    # A batch of 6e9 reviews: C(n, 2) and c * below pass 2^63, which ANSI
    # BIGINT arithmetic would reject.
    sets = spark.createDataFrame(
        [("h", "k1", 3, 4_000_000_000, 0.3 * 4e9), ("h", "k2", 5, 2_000_000_000, 0.2 * 2e9)],
        "batch string, _set string, n_distinct int, m bigint, ttr_sum double")
    r = spam.bounds_from_sets(sets).collect()[0]
    n = 6e9
    pairs = n * (n - 1) / 2
    lo = (4e9 * (4e9 - 1) / 2 + 2e9 * (2e9 - 1) / 2) / pairs
    hi = (4e9 * (4e9 - 1) / 2 + 2e9 * (2e9 - 1) / 2 + 2e9 * (4e9 * 3) / 5) / pairs
    assert r["n"] == 6_000_000_000
    assert abs(r["jaccard_lo"] - lo) < 1e-12 and abs(r["jaccard_hi"] - hi) < 1e-12


def test_flagged_null_batch_is_dropped(spark):
    spam_text = "great great great great great"
    rows = [(i, None, spam_text) for i in range(1, 5)] + [(10, "b", "the nurses were kind"),
                                                          (11, "b", "doctor was rude")]
    df = spark.createDataFrame(rows, "review_id long, batch string, reviews string")
    out = spam.drop_spam_batches(df, spam.spam_gate(df), gate_materialized=True)
    assert sorted(r["review_id"] for r in out.collect()) == [10, 11]
    assert "BroadcastHashJoin" in _plan(out)


def test_null_batch_goes_down_the_same_ladder(spark):
    rows_u = [(i, None, r) for i, r in enumerate(["a a a a a"] * 5 + ["b b b b b"] * 5)]
    rows_o = [(100 + i, "o", _rep(x)) for i, x in enumerate(["c f g h"] * 7 + ["c g h"] * 2 + ["c f h"])]
    df = spark.createDataFrame(rows_u + rows_o, "review_id long, batch string, reviews string")
    for mode in (False, True):
        got = {r["batch"]: r for r in spam.spam_gate(df, all_bounds=mode).collect()}
        assert got[None]["decided_by"] == "pair_upper_bound" and got[None]["n"] == 10
        assert got["o"]["decided_by"] == "estimate" and abs(got["o"]["avg_jaccard"] - 0.861) < 0.08
    # the same open batch under a NULL key gets the same estimate
    df_null = spark.createDataFrame([(i, None, r) for i, _, r in rows_o], "review_id long, batch string, reviews string")
    g = spam.spam_gate(df_null).collect()[0]
    assert g["decided_by"] == "estimate" and g["avg_jaccard"] == got["o"]["avg_jaccard"]


def test_explicit_broadcast_without_auto_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = _mixed(spark)
        out = spam.drop_spam_batches(df, spam.spam_gate(df), gate_materialized=True)
        assert sorted(r["review_id"] for r in out.collect()) == [100, 101, 102]
        assert "BroadcastHashJoin" in _plan(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_estimate_query_counts_whole_minima(spark, tmp_path):
    """The registered estimate against minima taken in plain Python: no cells, no
    correction for them."""
    import hashlib
    import statistics

    from revlens.plans.derived import TEMPLATES
    from revlens.plans.queries import QUERIES

    rng = random.Random(11)
    docs = [(i, "ab"[i % 2], "en", " ".join(rng.choice("pqrstuvwxyz") for _ in range(rng.randint(1, 12)))) for i in range(24)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["batch"]: r for r in QUERIES["batch_jaccard_estimate"](spark, str(tmp_path)).collect()}
    for b in "ab":
        sets = [set(f"{TEMPLATES[i % len(TEMPLATES)]} {t}".split()) for i, s, _, t in docs if s == b]
        xs = [[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % spam.MERSENNE_31 for t in s] for s in sets]
        pairs = len(xs) * (len(xs) - 1) / 2
        shares = []
        for a, c in spam.hash_params():
            least = [min((a * x + c) % spam.MERSENNE_31 for x in s) for s in xs]
            shares.append(sum(x == y for i, x in enumerate(least) for y in least[:i]) / pairs)
        assert got[b]["n"] == len(xs) and abs(got[b]["jaccard_est"] - statistics.mean(shares)) < 2e-6
        assert abs(got[b]["jaccard_se"] - statistics.stdev(shares) / len(shares) ** 0.5) < 2e-6
