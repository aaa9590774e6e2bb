"""Whole-text token ids from the ``tokenizers`` library, with a bounded cache.

Pre-tokenisation of the vocabularies used here never joins characters across
the start of a white-space run, so a text can be cut there and each part encoded
on its own with the same ids. Most parts are words seen before. Parts are
hashed (64 bits) for a whole batch at once, looked up in a sorted table of
hashes, and the ids of a batch are gathered in one step; only unknown parts go
through the library. The table is bounded (``MAX_PARTS``) and starts anew when
it is full.
"""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
import zlib

import numpy as np

from .common import WORKER_CACHE, _powers, is_space, mix, utf8

# White space in Unicode's sense that is not ASCII: a text with such
# characters is encoded whole where white space belongs to a part.
EXOTIC_SPACE = re.compile("[\x85\xa0  -     　]")
MAX_PARTS = 1_000_000
BATCH_CHARS = 1 << 20
_JOIN = 256
_SPACES = b" \t\n\r\x0b\x0c"


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine (also on executors)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Table:
    """Sorted hashes with (offset, length) of their ids in one flat array; new
    entries gather in a second, smaller table first."""

    def __init__(self):
        self.main = self._empty()
        self.recent = self._empty()
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0

    @staticmethod
    def _empty():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __len__(self):
        return len(self.main[0]) + len(self.recent[0])

    def find(self, h: np.ndarray):
        """(known, offset, length) of distinct hashes."""
        known = np.zeros(len(h), bool)
        off, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for keys, o, n in (self.main, self.recent):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                off[hit], size[hit] = o[at[hit]], n[at[hit]]
                known |= hit
        return known, off, size

    def add(self, h: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Store ids of sorted new hashes (``ids`` in their order); their offsets."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        off = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.recent = self._merge(self.recent, (h, off, sizes.astype(np.int32)))
        if len(self.recent[0]) > 100_000:
            self.main, self.recent = self._merge(self.main, self.recent), self._empty()
        return off

    @staticmethod
    def _merge(a, b):
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b))


class Encoder:
    """Encodes texts to unsigned 32-bit ids, equal to encoding each whole."""

    def __init__(self, path: str, keep_space: bool, max_parts: int = MAX_PARTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True  # their strings in a text are ordinary text
        self._setup(keep_space, max_parts)
        # Bytes that a token stands for: both vocabularies write one character
        # per byte, the word-end mark apart.
        vocab = self.plain.get_vocab(with_added_tokens=False)
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.token_bytes[i] = len(token.removesuffix("</w>"))

    def _setup(self, keep_space: bool, max_parts: int) -> None:
        self.keep_space = keep_space
        self.max_parts = max_parts
        self.table = _Table()

    # What a subclass may change: how a text is prepared, which bytes part it,
    # and which texts only the library can take.
    before = b""

    def is_break(self, buf: np.ndarray) -> np.ndarray:
        return is_space(buf)

    def needs_library(self, text: str) -> bool:
        return self.keep_space and not text.isascii() and EXOTIC_SPACE.search(text) is not None

    def whole(self, text: str) -> np.ndarray:
        """A text's ids straight from the library."""
        return np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _joinable(self, part: str, raw: bytes) -> bool:
        """Whether a part can be encoded next to others in one string."""
        if self.keep_space:
            return raw[0] in _SPACES and raw[-1] not in _SPACES
        return len(raw) == len(part) or (unicodedata.is_normalized("NFC", part)
                                         and len(part.lower().encode("utf-8", "surrogatepass")) == len(raw))

    def _encode_parts(self, raws: list[bytes]) -> list[np.ndarray]:
        parts = [r.decode("utf-8", "surrogatepass") for r in raws]
        out: list = [None] * len(parts)
        joint, single = [], []
        for i, (p, r) in enumerate(zip(parts, raws)):
            (joint if self._joinable(p, r) else single).append(i)
        glue = "" if self.keep_space else " "
        for k in range(0, len(joint), _JOIN):
            some = joint[k:k + _JOIN]
            ids = self.whole(glue.join([parts[i] for i in some]))
            ends = np.cumsum([len(raws[i]) for i in some])
            reached = np.cumsum(self.token_bytes[ids])
            at = np.searchsorted(reached, ends)
            if len(ids) and reached[-1] == ends[-1] and (reached[at] == ends).all():
                for i, a, b in zip(some, [0, *(at[:-1] + 1).tolist()], (at + 1).tolist()):
                    out[i] = ids[a:b]
            else:
                single += some
        if single:
            for i, e in zip(single, self.plain.encode_batch_fast([parts[i] for i in single], add_special_tokens=False)):
                out[i] = np.array(e.ids, np.uint32)
        return out

    def encode(self, texts) -> list[np.ndarray]:
        """Ids of each text. Call it with texts of a few megabytes together."""
        texts = [t or "" for t in texts]
        out: list = [None] * len(texts)
        todo = []
        for i, t in enumerate(texts):
            if self.needs_library(t):
                out[i] = self.whole(t)
            else:
                todo.append(i)
        if todo:
            for i, ids in zip(todo, self._batch([self.before + x for x in utf8([texts[i] for i in todo])])):
                out[i] = ids
        return out

    def _batch(self, enc: list[bytes]) -> list[np.ndarray]:
        size = np.array([len(t) for t in enc], np.int64)
        ends = np.cumsum(size)
        begins = ends - size
        blob = b"".join(enc)
        if not blob:
            return [np.zeros(0, np.uint32) for _ in enc]
        buf = np.frombuffer(blob, np.uint8)
        ws = self.is_break(buf)
        edge = np.zeros(len(buf) + 1, bool)
        edge[begins] = True
        edge = edge[:-1]
        first = np.empty(len(buf), bool)
        if self.keep_space:
            first[1:] = ws[1:] & ~ws[:-1]
            first |= edge
        else:
            first[1:] = ~ws[1:] & (ws[:-1] | edge[1:])
            first[0] = not ws[0]
        starts = np.flatnonzero(first)
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in enc]
        stops = np.append(starts[1:], len(buf))
        pos = np.arange(len(buf)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
        with np.errstate(over="ignore"):
            if self.keep_space:
                vals = (buf.astype(np.uint64) + np.uint64(1)) * _powers(int(pos.max()) + 1)[pos]
            else:
                pos[ws] = 0
                vals = (buf.astype(np.uint64) + np.uint64(1)) * _powers(int(pos.max()) + 1)[pos]
                vals[ws] = 0
                gaps = np.add.reduceat(ws.astype(np.int64), starts)
                stops = stops - gaps
            h = mix(np.add.reduceat(vals, starts))
        distinct, example, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.table) > self.max_parts:
            self.table = _Table()
        known, off, length = self.table.find(distinct)
        new = np.flatnonzero(~known)
        if len(new):
            e = example[new]
            ids = self._encode_parts([blob[a:b] for a, b in zip(starts[e].tolist(), stops[e].tolist())])
            n = np.array([len(x) for x in ids], np.int64)
            off[new] = self.table.add(distinct[new], n, np.concatenate(ids))
            length[new] = n
        n = length[which]
        total = np.cumsum(n)
        flat = self.table.flat[np.repeat(off[which] - (total - n), n) + np.arange(int(total[-1]))]
        total = np.append(0, total)
        lo, hi = total[np.searchsorted(starts, begins)], total[np.searchsorted(starts, ends)]
        return [flat[a:b] for a, b in zip(lo.tolist(), hi.tolist())]


def worker_cache() -> dict:
    """State that lives as long as the worker process, or until a task of
    another operator makes room (:func:`common.make_room`). Functions travel by
    value, so a module variable would start anew with every task."""
    return sys.modules.setdefault(WORKER_CACHE, types.ModuleType(WORKER_CACHE)).__dict__


def encoder(path: str, keep_space: bool) -> Encoder:
    """One encoder per worker process, reused by its tasks."""
    cache, key = worker_cache(), f"encoder {path} {keep_space}"
    if key not in cache:
        cache[key] = Encoder(path, keep_space)
    return cache[key]


def runs(texts, limit: int = BATCH_CHARS):
    """Lists of consecutive indices of about ``limit`` characters together."""
    run, n = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        n += len(t or "")
        if n >= limit:
            yield run
            run, n = [], 0
    if run:
        yield run


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
