"""Document fingerprints: Merkle trees over sections, paragraphs and sentences.

A text is cut into paragraphs (lines); paragraphs are grouped into sections
that end at a blank line or at a paragraph whose hash says so (about every
eighth), so an edit moves no border far from it. The leaves below a paragraph
are its sentences (cut after 40 characters at most). A paragraph node hashes its
text, a section its paragraphs' hashes, and the root its sections' hashes.

The fingerprint is the tree written as text:

    root/section:leaf-size.leaf-size,leaf-size;section:...

with ``,`` between paragraphs, ``;`` between sections, sizes in hex. Equal roots
mean equal texts; two trees are compared from the top, equal sections are taken
whole, and the remaining leaves show where the texts differ.

Defined results: a null or empty text is a tree without sections and equals any
other empty text (likeness 1); repeated rows have equal fingerprints; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b, sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_column, ids_of, safe_text
from .substrings import dealt

_PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+")
_SENTENCE = re.compile(r"[^.!?\n]{1,40}[.!?\n]*|[.!?\n]+")
# A paragraph whose hash starts with one of these ends its section.
_BORDER = frozenset("01")
RANGE_CHARS = 8_000_000


def _hash(data: bytes, size: int) -> str:
    return blake2b(data, digest_size=size).hexdigest()


def fingerprint(text: str | None) -> str:
    sections, current, hashes = [], [], []

    def close():
        sections.append(_hash("".join(hashes).encode(), 8) + ":" + ",".join(current))
        current.clear()
        hashes.clear()

    for paragraph in _PARAGRAPH.findall(text or ""):
        leaves = [_hash(s.encode("utf-8", "surrogatepass"), 4) + f"-{len(s):x}" for s in _SENTENCE.findall(paragraph)]
        node = ".".join(leaves)
        h = _hash(paragraph.encode("utf-8", "surrogatepass"), 8)
        current.append(node)
        hashes.append(h)
        if h[0] in _BORDER or not paragraph.strip():
            close()
    if current:
        close()
    root = _hash("".join(s[:16] for s in sections).encode(), 16)
    return root + "/" + ";".join(sections)


def _sections(fp: str) -> list[tuple[str, str]]:
    body = fp[33:]
    return [(s[:16], s[17:]) for s in body.split(";")] if body else []


def _leaves(body: str) -> Counter:
    return Counter(x for p in body.split(",") for x in p.split(".") if x)


def _size(leaf: str) -> int:
    return int(leaf[9:], 16)


def likeness(a: str, b: str) -> float:
    """Share of characters in leaves that both trees have (0 to 1)."""
    if a[:32] == b[:32]:
        return 1.0
    sa, sb = _sections(a), _sections(b)
    common = Counter(h for h, _ in sa) & Counter(h for h, _ in sb)  # whole branches
    ra, rb, shared, total = Counter(), Counter(), 0, 0
    left, right = common.copy(), common.copy()
    for (sections, take, rest) in ((sa, left, ra), (sb, right, rb)):
        for h, body in sections:
            leaves = _leaves(body)
            size = sum(_size(x) * c for x, c in leaves.items())
            total += size
            if take[h] > 0:
                take[h] -= 1
                shared += size
            else:
                rest.update(leaves)
    shared += 2 * sum(_size(x) * c for x, c in (ra & rb).items())
    return shared / total if total else 1.0


def differing_leaves(a: str, b: str) -> list[tuple[int, int]]:
    """(start, end) character spans of ``a`` whose leaves are not in ``b``,
    found by descending only into sections that ``b`` does not have."""
    theirs = {h for h, _ in _sections(b)}
    known = {x for h, body in _sections(b) for x in _leaves(body)}
    at, out = 0, []
    for h, body in _sections(a):
        for p in body.split(","):
            for leaf in p.split("."):
                if leaf:
                    if h not in theirs and leaf not in known:
                        if out and out[-1][1] == at:
                            out[-1] = (out[-1][0], at + _size(leaf))
                        else:
                            out.append((at, at + _size(leaf)))
                    at += _size(leaf)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def tree(text: pd.Series) -> pd.Series:
        return text.map(fingerprint)

    return docs.select("doc_id", tree(safe_text()).alias("fingerprint"))


def edited_text(text: str, following: str) -> str:
    """The last half of ``text`` replaced by the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Documents follow each other by descending doc_id (null ids last), the first
    follows the last; rows with equal ids stand in an order given by their texts.
    The table is dealt into ranges of about ``range_chars`` characters in that
    order (an id that fills ranges alone is spread over several); a task streams
    through the sorted documents of its ranges, and the first document of the next
    range travels along as a guest. One row per range reaches the driver.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows, n = dealt(docs, range_chars)
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # Ranges count up with the ids, null ids being the last ranges.
    heads = rows.groupBy("shard").agg(F.max(F.struct("doc_id", "hash")).alias("h"), F.first("no_id").alias("no_id")).collect()
    order = [r["shard"] for r in sorted(heads, key=lambda r: (r["no_id"], -r["shard"]))]
    head = {r["shard"]: (r["h"]["doc_id"], r["h"]["hash"]) for r in heads}
    host = {k: order[i - 1] for i, k in enumerate(order)}  # takes k's first document as guest

    @F.pandas_udf("int")
    def guest_of(shard: pd.Series, doc_id: pd.Series, hash_: pd.Series) -> pd.Series:
        return pd.Series([host[k] if head[k] == (i, h) else -1 for k, i, h in zip(shard.tolist(), doc_id.tolist(), hash_.tolist())], dtype="int32")

    rows = rows.withColumn("host", guest_of("shard", "doc_id", "hash"))
    places = F.expr("array_compact(array(named_struct('k', shard, 'guest', false), if(host >= 0, named_struct('k', host, 'guest', true), null)))")
    rows = rows.select(F.inline(places), "doc_id", "no_id", "hash", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n)
    rows = (rows.repartition(parts, "k").sortWithinPartitions("k", "guest", F.col("doc_id").desc(), F.col("hash").desc(), "text")
            .select("k", "guest", "doc_id", "no_id", "text"))

    def task(batches):
        held = None  # (k, doc_id, text, fingerprint)

        def pair(text, mine, other, theirs):
            edited = edited_text(text, other)
            fp = fingerprint(edited)
            return (len(text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mine, fp,
                    likeness(mine, fp), likeness(mine, theirs))

        cols = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for pdf in batches:
            ids, out = [], []
            for k, guest, doc, text in zip(pdf["k"].tolist(), pdf["guest"].tolist(), ids_of(pdf), pdf["text"].tolist()):
                if guest and (held is None or held[0] != k):
                    continue  # only the first guest of a range counts
                fp = fingerprint(text)
                if held is not None and held[0] == k:
                    ids.append(held[1])
                    out.append(pair(held[2], held[3], text, fp))
                held = None if guest else (k, doc, text, fp)
            if out:
                frame = pd.DataFrame(out, columns=cols)
                frame.insert(0, "doc_id", id_column(ids))
                yield frame

    return rows.mapInPandas(task, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                  "edited_fingerprint string, near_edited double, near_next double")
