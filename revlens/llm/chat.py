"""Chat formatting with token-level assembly.

Template: every turn is a header, the escaped text and an end mark:

    ### User: text</turn>

Inside texts (and roles without a header of their own) the control strings
``###`` and ``</turn>`` and the escape character ``\\`` itself are preceded by
``\\``, which is undone exactly when reading back.

Token ids are assembled from parts that are encoded separately: headers and end
marks are reserved ids outside the vocabulary, texts are encoded on their own,
so no text can produce a control id and no merge crosses a border. The loss
mask is 1 on assistant texts: +1 where such a text starts, -1 where it ends, and
a running sum over the positions.

Turns are encoded in the tasks that read them, then streamed in the order of
their conversation, one row a turn with running offsets; digests are folded over
the same stream. No conversation is held as a whole, so its length is not bounded
by memory (one task streams it).

Defined results: a null text or role is empty; turns are ordered by turn (null
first), then role, then text; repeated rows are turns of their own; rows with a
null conv_id are one conversation with a null id; an empty table gives no rows.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, exact_ids, id_column, ids_of
from .tokens import encoder, runs, vocabulary_path, worker_cache

VOCABULARY = "byte_bpe_50k.json"
HEADERS = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
OTHER = ("### Role ", " ###: ")
END = "</turn>\n"
# Reserved ids follow the vocabulary's 50,257.
FIRST_RESERVED = 50257
RESERVED = {"end": FIRST_RESERVED, "system": FIRST_RESERVED + 1, "user": FIRST_RESERVED + 2,
            "assistant": FIRST_RESERVED + 3, "other": FIRST_RESERVED + 4, "named": FIRST_RESERVED + 5}
_ESCAPE = re.compile(r"\\|###|</turn>")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>)")
# Header, text up to the first end mark that is not escaped.
_TURN = re.compile(r"### (?:(System|User|Assistant): |Role ((?:[^\\#]|\\\\|\\###|\\</turn>|#(?!##))*) ###: )"
                   r"((?:[^\\<]|\\\\|\\###|\\</turn>|<(?!/turn>))*)</turn>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def turn_text(role: str, text: str) -> str:
    return (HEADERS.get(role) or OTHER[0] + escape(role) + OTHER[1]) + escape(text) + END


def assemble(parts: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of turns given as (role, ids of role, ids of text)."""
    pieces, starts, ends, at = [], [], [], 0
    for role, role_ids, ids in parts:
        head = [RESERVED[role]] if role in HEADERS else [RESERVED["other"], *role_ids.tolist(), RESERVED["named"]]
        pieces += [np.array(head, np.uint32), ids, np.array([RESERVED["end"]], np.uint32)]
        if role == "assistant":
            starts.append(at + len(head))
            ends.append(at + len(head) + len(ids))
        at += len(head) + len(ids) + 1
    flat = np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)
    step = np.zeros(len(flat) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return flat, np.cumsum(step)[:-1].astype(np.uint8)


def _token_table(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary."""
    cache = worker_cache()
    if ("bytes", path) not in cache:
        from tokenizers import Tokenizer

        # Byte-level vocabularies write printable bytes as themselves and the
        # other bytes as the characters from U+0100 on, in byte order.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
        table = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            table[i] = bytes(byte_of.get(c, 63) for c in token)
        cache["bytes", path] = table
    return cache["bytes", path]


def read_tokens(ids: np.ndarray, mask: np.ndarray, path: str | None = None):
    """Turns (role, text) and the texts under the mask, from ids alone."""
    table = _token_table(path or vocabulary_path(VOCABULARY))

    def text(part) -> str:
        return unescape(b"".join([table[i] for i in part.tolist()]).decode("utf-8", "surrogatepass"))

    names = {v: k for k, v in RESERVED.items()}
    turns, at = [], 0
    control = np.flatnonzero(ids >= FIRST_RESERVED).tolist()
    k = 0
    while k < len(control):
        role, at = names[int(ids[control[k]])], control[k] + 1
        if role == "other":
            role = text(ids[at:control[k + 1]])
            at, k = control[k + 1] + 1, k + 1
        turns.append((role, text(ids[at:control[k + 1]])))
        k += 2
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    loss = [text(ids[a:b]) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return turns, loss


def read_text(formatted: str) -> list[tuple[str, str]]:
    """Turns (role, text) of a formatted conversation."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        out.append((m[1].lower() if m[1] else unescape(m[2]), unescape(m[3])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def format_conversations(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per turn: conv_id, n (from 0), formatted (text), ids (little-endian
    unsigned 32-bit), loss_mask (one byte per id), char_start and token_start
    (where the turn begins in its conversation)."""
    spark = conversations.sparkSession
    bound_batches(spark)
    path = vocabulary or vocabulary_path(VOCABULARY)

    def encode(batches):
        enc = encoder(path, keep_space=True)
        for pdf in batches:
            role_ids = enc.encode([escape(r) for r in pdf["role"]])
            ids: list = [None] * len(pdf)
            texts = [escape(t) for t in pdf["text"]]
            for run in runs(texts):
                for i, x in zip(run, enc.encode([texts[j] for j in run])):
                    ids[i] = x.astype("<u4").tobytes()
            pdf["role_ids"] = [x.astype("<u4").tobytes() for x in role_ids]
            pdf["ids"] = ids
            yield pdf

    def build(batches):
        held, n, chars, tokens = None, 0, 0, 0
        for pdf in batches:
            convs, rows = ids_of(pdf, "conv_id"), []
            for conv, no, role, text, a, b in zip(convs, *(pdf[c].tolist() for c in ("no_id", "role", "text", "role_ids", "ids"))):
                if held != (no, conv):
                    held, n, chars, tokens = (no, conv), 0, 0, 0
                shown = turn_text(role, text)
                ids, mask = assemble([(role, np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"))])
                rows.append((n, shown, ids.astype("<u4").tobytes(), mask.tobytes(), chars, tokens))
                n, chars, tokens = n + 1, chars + len(shown), tokens + len(ids)
            out = pd.DataFrame(rows, columns=["n", "formatted", "ids", "loss_mask", "char_start", "token_start"])
            out.insert(0, "conv_id", id_column(convs))
            yield out

    empty = F.lit("")
    turns = conversations.select(*exact_ids("conv_id"), F.col("turn").cast("long").isNotNull().alias("has_turn"),
                                 F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                                 F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = ["no_id", "conv_id"]
    return (turns.mapInPandas(encode, "conv_id long, no_id boolean, has_turn boolean, turn long, role string, text string, role_ids binary, ids binary")
            .repartition(parts, *at).sortWithinPartitions(*at, "has_turn", "turn", "role", "text")
            .mapInPandas(build, "conv_id long, n long, formatted string, ids binary, loss_mask binary, char_start long, token_start long"))


def digests(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """What can be read back from formatted conversations, as digests that are
    folded over the turns in order."""
    spark = formatted.sparkSession
    bound_batches(spark)
    path = vocabulary or vocabulary_path(VOCABULARY)
    cols = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def task(batches):
        held, n, all_, loss, loss_chars, chars = None, 0, sha256(), sha256(), 0, 0

        def row():
            return n, all_.hexdigest(), loss_chars, loss.hexdigest(), chars

        def frame(convs, rows):
            out = pd.DataFrame(rows, columns=cols)
            out.insert(0, "conv_id", id_column(convs))
            return out

        for pdf in batches:
            convs, rows = [], []
            for conv, no, shown, ids, mask in zip(ids_of(pdf, "conv_id"), *(pdf[c].tolist() for c in ("no_id", "formatted", "ids", "loss_mask"))):
                if held != (no, conv):
                    if held is not None:
                        convs.append(held[1])
                        rows.append(row())
                    held, n, all_, loss, loss_chars, chars = (no, conv), 0, sha256(), sha256(), 0, 0
                turns, learned = read_tokens(np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8), path)
                if read_text(shown) != turns:
                    raise ValueError(f"text and ids of conversation {conv} differ")
                for role, text in turns:
                    all_.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for text in learned:
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    loss_chars += len(text)
                n, chars = n + len(turns), chars + len(shown)
            if rows:
                yield frame(convs, rows)
        if held is not None:
            yield frame([held[1]], [row()])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = ["no_id", "conv_id"]
    return (formatted.select(*exact_ids("conv_id"), "n", "formatted", "ids", "loss_mask").repartition(parts, *at)
            .sortWithinPartitions(*at, "n").drop("n")
            .mapInPandas(task, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
