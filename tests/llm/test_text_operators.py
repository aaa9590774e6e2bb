import collections
import hashlib
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revlens.llm import chat, licenses, merkle
from revlens.llm.oracle import ORACLE_SQL
from revlens.llm.tokens import vocabulary_path

CONTROL = st.lists(st.sampled_from(["\\", "#", "##", "###", "</turn>", "<", "/", "\n", ": ", "a", "é", "### User: ", " ###: "]),
                   max_size=8).map("".join)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant"]), CONTROL), CONTROL), max_size=4))
def test_template_is_reversible(turns):
    assert chat.read_text("".join(chat.turn_text(r, t) for r, t in turns)) == turns


def test_format_conversations(spark):
    text = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", text, 1), (-7, 1, "assistant", text, 1), (1, 2, "assistant", "second", 1), (1, 1, "assistant", None, 1),
            (1, 0, "system", "sys ###", 1), (1, None, "user", "early", 1), (2, 0, None, "x", 1), (2, 0, "tool: a", "y", 1),
            (2, 0, "tool: a", "y", 1), (None, 0, "assistant", "nobody", 1), (2**53 + 1, 0, "user", "big", 1), (2**53 + 3, 0, "user", "big", 1), (3, 0, "assistant", "w " * 30_000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int").coalesce(1)
    out = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, x, _ in rows:
        groups[c].append((t is not None, t or 0, role or "", x or ""))
    assert set(out) == set(groups)
    for c, turns in groups.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        assert out[c].n_turns == len(turns)
        assert out[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for r, x in turns))
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), sha(loss))
        assert out[c].formatted_chars == sum(len(chat.turn_text(r, x)) for r, x in turns)
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_token_masks_cover_assistant_texts(spark):
    import numpy as np
    from tokenizers import Tokenizer

    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "there ### x")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_conversations(df).collect(), key=lambda r: r.n)
    assert [(r.char_start, r.token_start) for r in rows] == [(0, 0), (len(rows[0].formatted), len(rows[0].ids) // 4)]
    ids, mask = np.frombuffer(b"".join(r.ids for r in rows), "<u4"), np.frombuffer(b"".join(r.loss_mask for r in rows), np.uint8)
    t = Tokenizer.from_file(vocabulary_path(chat.VOCABULARY))
    assert ids[mask == 1].tolist() == t.encode(chat.escape("there ### x"), add_special_tokens=False).ids
    assert (ids >= chat.FIRST_RESERVED).sum() == 4 and len(ids) == len(mask)


def test_fingerprints_follow_the_text():
    a = "One two three. Four five six seven.\nNew paragraph here.\n\nAnother section, with words.\n"
    b = a.replace("five", "FIVE")
    fa, fb = merkle.fingerprint(a), merkle.fingerprint(b)
    assert fa == merkle.fingerprint(a) and fa[:32] != fb[:32]
    assert 0.5 < merkle.likeness(fa, fb) < 1
    (start, end), = merkle.differing_leaves(fa, fb)
    assert "five" in a[start:end] and end - start < len(a) / 2
    assert merkle.likeness(fa, merkle.fingerprint("nothing alike")) == 0
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint(None)) == 1


def expected_neighbours(df, range_chars):
    """Rows of one id stand by range and by the hash of their text, downwards."""
    rows = [(r.doc_id, r.text, r.shard, r.hash, r.no_id) for r in
            merkle.dealt(df, range_chars)[0].withColumn("hash", F.xxhash64("text")).collect()]
    order = sorted(rows, key=lambda r: (r[4], -r[0], -r[2], -r[3]))
    for k, (i, t, _, _, no) in enumerate(order):
        i, nxt = None if no else i, order[(k + 1) % len(order)][1]
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        f, g = merkle.fingerprint(t), merkle.fingerprint(edited)
        yield (str(i), len(t), sha(edited), f, g, merkle.likeness(f, g), merkle.likeness(f, merkle.fingerprint(nxt)))


@pytest.mark.parametrize("range_chars", [8_000_000, 20_000])
def test_compare_with_next(spark, documents, odd, mixed, none, texts, range_chars):
    one_id = spark.createDataFrame([(5, f"text {k} " * (k % 40)) for k in range(300)] + [(2, "two"), (9, "nine")], "doc_id long, text string")
    for df in (documents, odd, mixed, one_id, odd.where("doc_id = 7")):
        got = sorted((str(r.doc_id), *r[1:]) for r in merkle.compare_with_next(df, range_chars).collect())
        assert len(got) == df.count() and got == sorted(expected_neighbours(df, range_chars))
    assert merkle.compare_with_next(none, range_chars).count() == 0


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_scan(t):
    w, places = words(t), []
    for p, label in licenses.PHRASES.items():
        p = p.split()
        places += [(k, label) for k in range(len(w)) if w[k:k + len(p)] == p]
    found, best = set(), 0.0
    for line in (t or "").split("\n"):
        have = set(words(line))
        for text, label in licenses.NOTICES:
            need = set(text.split())
            if len(have & need) >= licenses.CONTAINMENT * len(need) - 1e-9:
                found.add(label)
                best = max(best, len(have & need) / len(need))
    base = {x for _, x in places}
    starts = [k for k, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | found)), 1.0 if places else best)


def test_license_scan_brute_force(spark, odd):
    rng = random.Random(3)
    vocab = sorted({w for t, _ in licenses.NOTICES for w in t.split()}) + ["other", "MIT", "é"]
    rows = [(i, "\n".join(rng.choice([" ".join(rng.choices(vocab, k=rng.randrange(12))), rng.choice(licenses.NOTICES)[0].upper(),
                                      "CC-BY by", "the Apache\tLicense apache license"]) for _ in range(rng.randrange(5)))) for i in range(150)]
    rows += [(1000 + (r.doc_id or 0), r.text) for r in odd.select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("x")).withColumn("n_words", F.lit(0))
    got = sorted(map(str, ((r.doc_id, *r[1:]) for r in licenses.scan(df).collect())))
    assert got == sorted(map(str, ((i, *brute_scan(t)) for i, t in rows)))
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_scan_agrees_with_sql(spark, documents, texts):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    rel = con.sql(ORACLE_SQL["op10_licenses"])
    want = sorted(map(str, rel.fetchall()))
    assert sorted(map(str, (tuple(r) for r in licenses.scan(documents).select(*rel.columns).collect()))) == want


def brute_notices(t):
    w, found = words(t), {}
    for text, label in licenses.NOTICES:
        need, n = set(text.split()), licenses.SPREAD * len(text.split())
        have = max(len(need & set(w[k:k + n])) for k in range(max(len(w) - n, 0) + 1))
        if have >= licenses.CONTAINMENT * len(need) - 1e-9:
            found[label] = max(found.get(label, 0), have / len(need))
    return found


def test_notices_over_lines_and_scattered_words(spark):
    rng = random.Random(4)
    rows = []
    for text, _ in licenses.NOTICES:
        ws = text.split()
        for cut in (1, len(ws) // 2, len(ws) - 1):  # wrapped, at any place of the text
            before = " ".join(rng.choices(["filler", "the", "of"], k=rng.randrange(120)))
            rows.append(before + " " + " ".join(ws[:cut]) + "\n * " + " ".join(ws[cut:]) + "\n" + before)
        rows.append("\n".join(ws))  # one word a line
        for gap in (1, 2, 40):  # scattered over one line
            rows.append(" ".join(w + " filler" * gap for w in ws))
    for _ in range(60):
        a, b = rng.choice(licenses.NOTICES)[0].split(), rng.choice(licenses.NOTICES)[0].split()
        rows.append(" ".join(rng.choice(a + b + ["x", "\n"]) for _ in range(rng.randrange(150))))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = collections.defaultdict(dict)
    for r in licenses.notice_matches(df).collect():
        got[r.doc_id][r.label] = max(got[r.doc_id].get(r.label, 0), r.containment)
    want = {i: f for i, f in enumerate(map(brute_notices, rows)) if f}
    assert dict(got) == want
    step = 7
    for k, (_, label) in enumerate(licenses.NOTICES):
        assert all(label in want[k * step + j] for j in range(4))
        assert label not in want.get(k * step + 6, {})


def test_license_twin_finds_wrapped_notices(spark):
    """The SQL twin applies the operator's rule: stretches over line ends."""
    rng = random.Random(8)
    rows = []
    for i, (text, _) in enumerate(licenses.NOTICES * 3):
        w = text.split()
        for _ in range(rng.randrange(3)):
            w.insert(rng.randrange(len(w) + 1), "filler")
        wrapped = "".join(x + rng.choice([" ", "\n", "\n * ", "  "]) for x in w)
        rows.append((i, "words before " * rng.randrange(4) + wrapped + " and after"))
    rows += [(1000, "released " + "x " * 40 + "under " + "x " * 40 + "the mit " + "x " * 40 + "license"), (1001, None), (1002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.sql(ORACLE_SQL["op10_licenses"])
    cols = want.columns
    got = [tuple(r) for r in licenses.scan(df).select(*cols).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))
    labels = {r[cols.index("doc_id")]: r[cols.index("labels")] for r in got}
    assert all(labels[i] for i in range(len(licenses.NOTICES) * 3)) and labels[1000] == ""
