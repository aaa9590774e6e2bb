import collections
import random
import zlib
from hashlib import blake2b, sha256

import pytest

from revlens.llm import prefix_trie as P


def test_two_fattest():
    for a in range(40):
        for b in range(a + 1, 60):
            want = max(range(a + 1, b + 1), key=lambda x: (x & -x, -x))
            assert P.two_fattest(a, b) == want


def prefixes(seq):
    p = [P.ROOT]
    for x in seq:
        p.append(blake2b(p[-1] + bytes([x]), digest_size=16).digest())
    return p


def test_trie_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        trie, seqs = P.ZFastTrie(), []
        for c in range(rng.randint(1, 40)):
            s = rng.choice(seqs)[:rng.randint(0, 12)] if seqs and rng.random() < .6 else []
            s = s + [rng.randrange(3) for _ in range(rng.randint(0, 12))]
            seqs.append(s)
            trie.insert(prefixes(s), [0, *s], c, c * c, 1)
        want = collections.defaultdict(list)
        for c, s in enumerate(seqs):
            p = prefixes(s)
            for d, x in enumerate(p):
                want[x].append((c, d, p[d - 1] if d else None, s[d - 1] if d else 0))
        got = {r[0]: r[1:] for r in trie.expand()}
        assert got == {x: (v[0][2], v[0][1], v[0][3], len(v), min(c for c, *_ in v), sum(c * c for c, *_ in v), len(v)) for x, v in want.items()}


def brute(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [x for _, x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seqs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = collections.Counter(s[:-1] for s in members if s)
    out = []
    for s, cs in members.items():
        below = [x for x in members if x[:len(s)] == s]
        ends = sorted(c for c in cs if len(seqs[c]) == len(s))
        out.append((min(cs), len(s), min(members[s[:-1]]) if s else None, len(cs), children[s], sum(children[x] == 0 for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows(rng):
    rows = []
    for c in [*range(0, 40), *range(100, 230), 2**53 + 1, 2**53 + 3, -7, -205]:
        length = rng.choice([0, 1, 1, 3, 8, 12])
        for k in range(length):
            text = "hello" if k == 0 and rng.random() < .5 else rng.choice(["a", "bé", "", None, "日本"])
            rows.append((c, k if rng.random() < .95 else None, rng.choice(["user", "assistant", None]) if k else "user", text))
    rows += rows[:3]  # repeated rows are turns of their own
    rows += [(None, 0, "user", "hello"), (None, 1, "assistant", "x")]
    return rows


@pytest.mark.parametrize("depths", [5, 200_000])
def test_whole_job_against_brute_force(spark, monkeypatch, depths):
    monkeypatch.setattr(P, "TRIE_DEPTHS", depths)
    rows = some_rows(random.Random(6))
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string")
    got = P.prefix_trie(df).drop("node", "parent").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_end_blocks(spark, monkeypatch):
    """Ids of one node joined over many blocks, in numeric order."""
    monkeypatch.setattr(P, "END_BLOCK", 3)
    ids = [5, -4, 0, 10, 9, 100, 2, -1, 33]
    df = spark.createDataFrame([(bytes(16), i) for i in ids], "node binary, conv long")
    assert P._end_digests(df).collect()[0].ends_sha256 == sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def test_empty_and_turnless(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert P.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    one = P.prefix_trie(spark.createDataFrame([(c, 0, "user", "x")], schema)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.saved_tokens) for r in one] == [(c, 0, 1, 1, 0)]
    assert one[0].ends_sha256 == sha256(str(c).encode()).hexdigest()
