"""Single-pass multi-keyword scan of the lower-cased review (TXT-2, JON-1/2).

The gate asks, per aspect, whether any of ~50 keywords occurs as a substring;
tagging and masking ask which of ~400 keywords occur as whole words. Done with
built-in expressions that is one ``contains``/regex scan of the text *per
keyword*. An Aho-Corasick automaton finds every occurrence of every keyword in
one pass, so this operator runs as an Arrow-batched pandas UDF over the
``_low`` column only (the other columns stay in the JVM). Output per review:

* ``gate_mask`` -- bit *i* set iff an ``api`` keyword of ``ASPECTS[i]`` is a
  substring;
* ``hits`` -- distinct keywords found as whole words (word character =
  letter, digit or ``_``, the same class as the JVM and SQL forms);
* ``at`` -- where each of them first occurs (code points from 0).

Word characters are what the JVM's regex engine takes for ``[\\p{L}\\p{N}_]``:
the class is read from the session once (:func:`word_class`) and travels with
the task, so the Python library's own Unicode version does not matter and both
engines agree on every code point. The ``ahocorasick`` library must be installed
on the executors; a task without it fails with its import error, and
``engine='jvm'`` is the choice that needs no library.
"""

from __future__ import annotations

import sys
from typing import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T
from ..session import bound_batches

# Functions here run inside Python workers; ship this module's code with the
# task (pickled by value) so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCAN_TYPE = Ty.StructType([Ty.StructField("gate_mask", Ty.IntegerType(), False),
                           Ty.StructField("hits", Ty.ArrayType(Ty.StringType(), False), False),
                           Ty.StructField("at", Ty.ArrayType(Ty.IntegerType(), False), False)])


_CLASSES: dict[str, bytes] = {}


def word_class(spark: SparkSession) -> bytes:
    """One byte per code point: 1 for word characters by the JVM's regex class.
    One row of fixed size (all code points) is sent and read back, once per
    application."""
    key = str(spark.conf.get("spark.app.id", "")) or "session"
    if key not in _CLASSES:
        points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
        row = (spark.createDataFrame([(points,)], "s string")
               .select(F.regexp_replace("s", T.NON_WORD_RUN, "").alias("w")).first())
        table = bytearray(0x110000)
        for ch in row["w"]:
            table[ord(ch)] = 1
        _CLASSES[key] = bytes(table)
    return _CLASSES[key]


class KeywordScanner:
    """Plain-Python scan (used inside the UDF and by tests)."""

    def __init__(self, gate_keywords: list[list[str]], word_keywords: list[str], word_class: bytes):
        import ahocorasick

        self.word_class = word_class

        table: dict[str, list[int]] = {}
        for bit, kws in enumerate(gate_keywords):
            for k in kws:
                table.setdefault(k, [0, 0])[0] |= 1 << bit
        for k in word_keywords:
            table.setdefault(k, [0, 0])[1] = 1
        self.automaton = ahocorasick.Automaton()
        for k, (mask, want_word) in table.items():
            self.automaton.add_word(k, (k, mask, want_word))
        self.automaton.make_automaton()
        self.full_mask = (1 << len(gate_keywords)) - 1

    def scan(self, text: str) -> tuple[int, list[str], list[int]]:
        mask = 0
        hits: dict[str, int] = {}
        n = len(text)
        cls = self.word_class
        for end, (kw, kmask, want_word) in self.automaton.iter(text):
            mask |= kmask
            if want_word and kw not in hits:
                start = end - len(kw) + 1
                if (start == 0 or not cls[ord(text[start - 1])]) and \
                        (end + 1 >= n or not cls[ord(text[end + 1])]):
                    hits[kw] = start
        return mask, list(hits), list(hits.values())


def scan_column(spark: SparkSession, low: Column, gate_keywords: list[list[str]], word_keywords: list[str]) -> Column:
    """``struct<gate_mask, hits>`` for each lower-cased text (NULL text -> mask 0, no hits)."""
    gate_keywords = [list(k) for k in gate_keywords]
    word_keywords = list(word_keywords)
    classes = word_class(spark)
    bound_batches(spark)

    @F.pandas_udf(SCAN_TYPE)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = KeywordScanner(gate_keywords, word_keywords, classes)
        for texts in batches:
            found = [(0, [], []) if t is None or isinstance(t, float) else scanner.scan(t) for t in texts]
            masks, hits, at = zip(*found) if found else ((), (), ())
            yield pd.DataFrame({"gate_mask": pd.Series(masks, dtype="int32"), "hits": list(hits), "at": list(at)})

    return scan(low)
