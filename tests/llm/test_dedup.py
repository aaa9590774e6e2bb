import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from revlens.llm import components as C
from revlens.llm import exact_dedup as E
from revlens.llm import hyperminhash as H


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup_brute_force(documents, texts):
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[norm(t)].append(i)
    out = E.exact_dedup(documents).collect()
    assert len(out) == len(texts)
    for r in out:
        g = groups[norm(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (min(g), len(g), r.doc_id == min(g))


def test_exact_dedup_odd_rows(odd, none):
    out = E.exact_dedup(odd, keep=["score", "n"]).collect()
    assert len(out) == odd.count()
    size = collections.Counter((r.keep_id, r.group_size) for r in out)
    assert size[(1, 5)] == 5  # ids 1, 5, null, 13, 13
    assert size[(2, 3)] == 3  # null text, empty text, null id with null text
    assert [r.kept for r in out if r.doc_id == 4] == [True]  # white space only is one space, not empty
    assert [(r.keep_id, r.kept) for r in out if r.doc_id == 8] == [(7, False)]
    assert {(r.score, r.n) for r in out} == {(0.5, -1)}
    assert E.exact_dedup(none).count() == 0


def test_drop_copies_keeps_one_row(odd):
    left = E.drop_copies(odd)
    assert left.columns == odd.columns
    kept = [norm(r.text) for r in left.collect()]
    assert len(kept) == len(set(kept)) == len({norm(r.text) for r in odd.select("text").collect()})


@pytest.mark.parametrize("bound", [0, 40])
def test_exact_dedup_above_the_broadcast_bound(odd, documents, texts, monkeypatch, bound):
    """Lists too long to broadcast: same result, and no text in any exchange."""
    from revlens.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[norm(t)].append(i)
    out = E.exact_dedup(documents)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out.collect()} == {(i, min(g), len(g)) for g in groups.values() for i in g}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "norm" not in plan  # only written keys and digests are joined
    assert E.exact_dedup(odd).count() == odd.count()
    kept = [norm(r.text) for r in E.drop_copies(odd).collect()]
    assert len(kept) == len(set(kept)) == len({norm(r.text) for r in odd.select("text").collect()})
    assert {r.doc_id for r in E.drop_copies(documents).collect()} == {min(g) for g in groups.values()}


def test_survivors_only_are_hashed(spark):
    """Rows that share length but not prefix are settled without a digest."""
    df = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "abcd"), (4, "abc")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in E.exact_dedup(df).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (3, 1), 4: (1, 2)}


def shingles(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if len(w) >= width:
        return frozenset(zip(*[w[k:] for k in range(width)]))
    return frozenset([tuple(w)] if w else [])


def brute(rows, width, percent):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, width)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            n = len(a & b)
            if a and b and 100 * n >= percent * (len(a) + len(b) - n):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


@pytest.fixture(scope="module")
def clustered(spark, texts):
    """Real texts, near copies of some of them, and chains of near copies."""
    rows = [(i, t) for i, t in texts.items() if len(t.split()) < 600][:60]
    base = next(t for _, t in rows if len(t.split()) > 150).split()
    for k in range(90):
        w = list(base)
        for p in range(0, 1 + k % 9):
            w[(7 * k + 13 * p) % len(w)] = f"edit{k}x{p}"
        rows.append((1000 + k, " ".join(w)))
    chain = base[:120]
    for k in range(8):
        chain = chain[:]
        chain[10 * k + 3] = f"link{k}"
        rows.append((2000 + k, " ".join(chain).upper()))
    return rows


@pytest.mark.parametrize("block, rule", [(1024, H.Rule(3, 85, 5)), (16, H.Rule(3, 85, 5)), (1024, H.Rule())])
def test_near_dedup_brute_force(spark, clustered, monkeypatch, block, rule):
    monkeypatch.setattr(H, "BLOCK", block)
    want = brute(clustered, rule.shingle, rule.percent)
    out = H.near_dedup(spark.createDataFrame(clustered, "doc_id long, text string"), rule).collect()
    assert {r.doc_id: r.component_id for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert all(r.n_shingles == len(shingles(dict(clustered)[r.doc_id], rule.shingle)) for r in out)


def test_near_dedup_odd_rows(odd, none):
    out = H.near_dedup(odd, H.Rule(3, 85, 5)).collect()
    assert len(out) == odd.count()
    by = collections.defaultdict(set)
    for r in out:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by[2] == {(0, 2, True)} and by[3] == {(0, 3, True)} and by[4] == {(0, 4, True)}
    assert by[6] == {(1, 6, True)}
    assert by[1] == {(5, 1, True)} and by[5] == {(5, 1, False)} and by[13] == {(5, 1, False)}
    assert by[8] == {(next(iter(by[7]))[0], 7, False)}
    assert by[None] == {(5, None, True), (0, None, True)}
    assert H.near_dedup(none).count() == 0
    left = H.drop_near_copies(odd)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 9, 10, 11, 12]


def test_repeated_ids_with_other_texts(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven", "red green blue cyan pink gray teal")
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (2**53 + 1, c), (None, a), (5, ""), (2**53 + 1, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = H.near_dedup(df).collect()
    # 5 has the texts of 3 and of 7: one component.
    assert sorted(((r.doc_id, r.component_id) for r in out if r.doc_id and r.n_shingles)) == [
        (3, 3), (5, 3), (5, 3), (7, 3), (9, 9), (2**53 + 1, 9), (2**53 + 1, 9)]
    left = sorted((str(r.doc_id), r.text) for r in H.drop_near_copies(df).collect())
    # Texts are dropped only where another one stays.
    assert left == sorted([("3", a), ("5", b), ("5", ""), ("9", c), ("None", a)])
    assert sorted(r.text for r in H.drop_near_copies(spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")).collect()) == [a, b]


def test_groups_are_bounded_by_shingles(spark, clustered, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_SHINGLES", 800)
    rule = H.Rule(3, 85, 5)
    out = H.near_dedup(spark.createDataFrame(clustered, "doc_id long, text string"), rule).collect()
    assert {r.doc_id: r.component_id for r in out} == brute(clustered, 3, 85)


def test_no_link_is_left_to_the_estimate(monkeypatch):
    """Pairs at the threshold are confirmed whatever their registers say."""
    import numpy as np

    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    a, b = pool[:90], np.concatenate([pool[:85], pool[200:205]])  # 85 of 95 and more
    sets = [np.sort(a), np.sort(b)]
    regs = np.array([H.registers(s) for s in sets])
    monkeypatch.setattr(H, "estimate", lambda x, y: np.zeros((len(x), len(y)), np.float32))
    assert H.links_within(sets, regs, 85) == [(0, 1)] and H.links_within(sets, regs, 90) == []


def test_intersections_and_registers():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (5, 60, 200, 1)]
    got = H.intersections(sets, sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))
    # The share of equal registers estimates the similarity.
    pool = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    a, b = pool[:3500], pool[500:]
    est = H.estimate(H.registers(a)[None], H.registers(b)[None])[0, 0]
    assert abs(est - 3000 / 4000) < 0.15


@pytest.mark.parametrize("per_task", [7, 50_000])
def test_components_of_chain_and_star(spark, monkeypatch, per_task):
    monkeypatch.setattr(C, "LINKS_PER_TASK", per_task)
    links = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100 + k: 100 for k in range(40)}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digest_of_query(spark, documents, texts):
    col = F.sha2(E.normalised(F.coalesce("text", F.lit(""))), 256)
    for r in documents.select("doc_id", col.alias("d")).limit(50).collect():
        assert r.d == hashlib.sha256(norm(texts[r.doc_id]).encode()).hexdigest()
