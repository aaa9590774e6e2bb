"""SentencePiece encoding and decoding, giant documents by a max-plus scan.

Ids equal those of the sentencepiece library for the whole text. Texts of up to
``GIANT`` characters are encoded by the library atom by atom (an atom: spaces and
what follows them), each distinct atom once per worker. A longer text is cut into
chunks that are encoded on different tasks:

* A segmentation is a path through pieces; the encoding is the one path on which
  every two neighbouring pieces stay as they are when their joined string is
  encoded (a pair that would merge differently has weight -inf, others 0; pieces
  never reach over the start of a white-space mark, where any pair is allowed).
* The state at a cut is the piece that covers the character before it. Both
  sides of a cut see the same ``CONTEXT`` characters around it and so list the
  same states in the same order.
* Each chunk yields the matrix of best path weights from the states of its left
  cut to those of its right cut. Matrices are combined by the associative
  max-plus product, with prefix and suffix scans over the chunks of a document;
  the state at a cut is where prefix and suffix weights add up to the maximum.
* With its two states fixed every chunk is backtraced on its own, again on
  different tasks, and the ids are put together in chunk order.

Only matrices (a few states squared per chunk) of one document meet in one task.

Defined results: a null or empty text has no ids; repeated rows are encoded one
by one; a null doc_id is carried through; an empty table gives no rows. Decoding
gives back the text as the library's normaliser leaves it, which for this
vocabulary is the text itself.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, safe_text, staged
from .tokens import MAX_PARTS, Encoder, runs, vocabulary_path, worker_cache

MODEL = "piece_bpe_32k.model"
GIANT = 1 << 15
CHUNK = 1 << 13
# Characters around a cut that both of its sides see; longer than any piece.
CONTEXT = 48
MARK = "▁"
_ATOM = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Model:
    """The library's model and what the scan needs of it."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {}
        self.id = {}
        for i in range(self.sp.get_piece_size()):
            if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i)):
                piece = self.sp.id_to_piece(i)
                self.score[piece], self.id[piece] = self.sp.get_score(i), i
        self.longest = max(map(len, self.score))
        self.text_of: list[bytes] | None = None
        self.encoder = PieceEncoder(self.sp)
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.merge = lru_cache(1 << 18)(self._merge)
        self.fits = lru_cache(1 << 18)(lambda a, b: self.merge(a + b) == (a, b))

    def _merge(self, s: str) -> tuple[str, ...]:
        """Pieces of a short string: the best-scored neighbouring pair merges
        first, of equal pairs the leftmost."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = self.score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def is_piece(self, s: str) -> bool:
        return len(s) == 1 or (s in self.score and self.merge(s) == (s,))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: the pieces' bytes joined, marks as spaces, without the
        mark that the normaliser puts before a text. Controls have no text."""
        if self.text_of is None:
            self.text_of = [b""] * self.sp.get_piece_size()
            for piece, i in self.id.items():
                self.text_of[i] = piece.replace(MARK, " ").encode()
            for b, i in enumerate(self.bytes):
                self.text_of[i] = bytes([b])
        table = self.text_of
        out = b"".join([table[i] for i in ids.tolist()])
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")

    def ids(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]


class PieceEncoder(Encoder):
    """Whole-text ids by the library through the table of known parts. A part
    is an atom: spaces (marks once normalised) and what follows them; the space
    put before every text is the mark that the normaliser adds."""

    before = b" "

    def __init__(self, sp, max_parts: int = MAX_PARTS):
        self.sp = sp
        self._setup(True, max_parts)

    def is_break(self, buf: np.ndarray) -> np.ndarray:
        return buf == 32

    def needs_library(self, text: str) -> bool:
        return not text or MARK in text  # a mark in the text itself counts as a space

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.sp.encode(text), np.uint32)

    def _encode_parts(self, raws: list[bytes]) -> list[np.ndarray]:
        parts = [r[1:].decode("utf-8", "surrogatepass") for r in raws]
        lone = np.array([self.sp.piece_to_id(MARK)], np.uint32)  # one space at the end of a text
        return [np.array(x, np.uint32) if p else lone for p, x in zip(parts, self.sp.encode(parts, num_threads=1))]


def model(path: str) -> Model:
    cache = worker_cache()
    if ("sentencepiece", path) not in cache:
        cache["sentencepiece", path] = Model(path)
    return cache["sentencepiece", path]


def _atom_end(text: str, at: int) -> int:
    """End of the atom that holds position ``at`` (an atom: marks, then others)."""
    m = _ATOM.match(text, at)
    return m.end() if m else at


def _atom_start(text: str, at: int) -> int:
    """Start of the atom that holds position ``at``."""
    while at > 0 and text[at] != MARK:
        at -= 1
        if text[at] == MARK:
            break
    while at > 0 and text[at] == MARK and text[at - 1] == MARK:
        at -= 1
    return at


def states(m: Model, text: str, cut: int) -> list[tuple[int, int]]:
    """Pieces (start, end) that can cover the character before ``cut``."""
    if cut <= 0:
        return [(cut, cut)]
    start, end = _atom_start(text, cut - 1), _atom_end(text, _atom_start(text, cut - 1))
    return [(s, e) for s in range(max(start, cut - m.longest), cut)
            for e in range(cut, min(end, s + m.longest) + 1) if m.is_piece(text[s:e])]


def _paths(m: Model, text: str, first: tuple[int, int], stop: int) -> dict:
    """Pieces reachable from ``first`` (each with its predecessor) up to those
    that reach ``stop``. All whole atoms before the one that holds ``stop`` are
    one step: what is inside them does not depend on what is around."""
    back: dict[tuple[int, int], tuple | None] = {first: None}
    last = _atom_start(text, stop - 1)
    todo = [first]
    while todo:
        s, e = todo.pop()
        if e >= stop:
            continue
        border = e == 0 or s == e or (text[e] == MARK and text[e - 1] != MARK)
        if border and last > e:
            if (e, last) not in back:
                back[e, last] = (s, e)
                todo.append((e, last))
            continue
        end = _atom_end(text, e if border else _atom_start(text, e))
        before = None if border else text[s:e]
        for x in range(e + 1, min(end, e + m.longest) + 1):
            node = (e, x)
            if node not in back and m.is_piece(text[e:x]) and (before is None or m.fits(before, text[e:x])):
                back[node] = (s, e)
                todo.append(node)
    return back


def _span_ids(m: Model, span: str) -> list[int]:
    """Ids of a piece, or of a run of whole atoms (by the library, which puts a
    mark of its own before its input)."""
    if span in m.id or len(span) == 1:
        return m.ids(span)
    if span[0] == MARK:
        return m.sp.encode(span[1:].replace(MARK, " "))
    return [x for piece in m.merge(span) for x in m.ids(piece)]


def transfer(m: Model, text: str, left: int, right: int) -> tuple[int, int, np.ndarray]:
    """Max-plus matrix of a chunk: weight 0 where the right state can be
    reached from the left one, -inf elsewhere."""
    a, b = states(m, text, left), states(m, text, right)
    t = np.full((len(a), len(b)), -np.inf)
    for i, x in enumerate(a):
        seen = _paths(m, text, x, right)
        for j, y in enumerate(b):
            if y in seen:
                t[i, j] = 0
    return t


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return (a[:, :, None] + b[None, :, :]).max(1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), -np.inf)


def scan(mats: list[np.ndarray], combine) -> list[np.ndarray]:
    """Inclusive prefix products by pairwise combination (associative scan)."""
    if len(mats) < 2:
        return list(mats)
    pairs = [combine(mats[k], mats[k + 1]) for k in range(0, len(mats) - 1, 2)]
    inner = scan(pairs, combine)
    out = [mats[0]]
    for k in range(1, len(mats)):
        out.append(inner[k // 2] if k % 2 else combine(inner[k // 2 - 1], mats[k]))
    return out


def choose(mats: list[np.ndarray]) -> list[tuple[int, int]]:
    """(left state, right state) of every chunk on the best path."""
    ahead = scan(mats, product)
    behind = scan([x.T for x in reversed(mats)], product)[::-1]  # row vectors from the end
    at = [0]
    for k in range(len(mats)):
        total = ahead[k].max(0)
        if k + 1 < len(mats):
            total = total + behind[k + 1].max(0)
        at.append(int(np.argmax(total)))
    return list(zip(at[:-1], at[1:]))


def backtrace(m: Model, text: str, left: int, right: int, i: int, j: int) -> list[int]:
    """Ids of a chunk's pieces after its left state up to its right state."""
    first, last = states(m, text, left)[i], states(m, text, right)[j]
    seen = _paths(m, text, first, right)
    node, spans = last, []
    while node != first:
        spans.append(node)
        node = seen[node]
    return [x for s, e in reversed(spans) for x in _span_ids(m, text[s:e])]


def chunks(m: Model, text: str, size: int = CHUNK):
    """(number, text with context, left cut, right cut) of a normalised text."""
    n = len(text)
    cuts = [*range(0, n, size), n]
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        lo, hi = max(a - CONTEXT, 0), min(b + CONTEXT, n)
        yield k, text[lo:hi], a - lo, b - lo


def encode_scan(m: Model, text: str, size: int = CHUNK) -> list[int]:
    """The whole scan in one place (what the Spark job does over tasks)."""
    parts = list(chunks(m, m.sp.normalize(text), size))
    picked = choose([transfer(m, t, a, b) for _, t, a, b in parts])
    return [x for (_, t, a, b), (i, j) in zip(parts, picked) for x in backtrace(m, t, a, b, i, j)]


def encode(docs: DataFrame, model_path: str | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chunks (1 unless scanned), ids (little-endian unsigned 32-bit)
    for every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    path = model_path or vocabulary_path(MODEL)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), safe_text().alias("text"))

    @F.pandas_udf("binary")
    def whole(text: pd.Series) -> pd.Series:
        enc, out = model(path).encoder, []
        for run in runs(text):
            out += [x.astype("<u4").tobytes() for x in enc.encode([text.iloc[i] for i in run])]
        return pd.Series(out, dtype=object)

    small = rows.where(F.length("text") <= giant).select("doc_id", F.lit(1).alias("n_chunks"), whole("text").alias("ids"))
    large = rows.where(F.length("text") > giant)

    def split(batches):
        m = model(path)
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"]):
                for k, t, a, b in chunks(m, m.sp.normalize(text), chunk):
                    yield pd.DataFrame({"key": [key], "k": [k], "part": [t], "a": [a], "b": [b]})

    # Repeated rows have equal ids: each distinct (doc_id, text) is scanned once
    # and comes back as often as it occurs.
    # The row's key is made once and travels with it; ids stay on this side.
    key = F.concat(F.md5("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    large = large.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("key", key)
    large = staged(large, "giant-texts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = staged(large.select("key", "text").mapInPandas(split, "key string, k int, part string, a int, b int")
                   .repartition(n, "key", "k"), "giant-chunks")

    def matrices(batches):
        m = model(path)
        for pdf in batches:
            mats = [transfer(m, t, a, b) for t, a, b in zip(pdf["part"], pdf["a"], pdf["b"])]
            yield pd.DataFrame({"key": pdf["key"], "k": pdf["k"], "n_left": [len(x) for x in mats],
                                "weights": [x.ravel() for x in mats]})

    def path_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        mats = [np.asarray(w, float).reshape(r, -1) for w, r in zip(pdf["weights"], pdf["n_left"])]
        i, j = zip(*choose(mats))
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "k": pdf["k"].to_numpy(), "i": i, "j": j})

    picked = (parts.mapInPandas(matrices, "key string, k int, n_left int, weights array<double>")
              .groupBy("key").applyInPandas(path_of, "key string, k int, i int, j int"))

    def trace(batches):
        m = model(path)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "k": pdf["k"], "ids": [
                np.array(backtrace(m, *x), "<u4").tobytes()
                for x in zip(pdf["part"], pdf["a"], pdf["b"], pdf["i"], pdf["j"])]})

    traced = (parts.join(picked, ["key", "k"]).select("key", "k", "part", "a", "b", "i", "j")
              .mapInPandas(trace, "key string, k int, ids binary"))

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n_chunks": [len(pdf)], "ids": [b"".join(pdf["ids"])]})

    scanned = traced.groupBy("key").applyInPandas(together, "key string, n_chunks int, ids binary")
    big = (scanned.join(large.select("key", "doc_id", "copies"), "key").withColumn("copy", F.explode(F.expr("sequence(1, int(copies))")))
           .select("doc_id", "n_chunks", "ids"))
    return small.unionByName(big)


def decode(encoded: DataFrame, model_path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the ``keep`` columns and the decoded text."""
    bound_batches(encoded.sparkSession)
    path = model_path or vocabulary_path(MODEL)

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        m = model(path)
        return pd.Series([m.decode(np.frombuffer(x, "<u4")) for x in ids], dtype=object)

    return encoded.select("doc_id", *(keep or []), text_of("ids").alias("text"))
