"""Keyword matching with a lexicon that is data (JON-1, SRC-6 at scale).

Lexicons too large for plan literals are tables of keywords. A keyword is the
sequence of its words, and a text holds it when these words stand consecutively
(whatever separates them). Texts are turned into their distinct n-grams of the
lengths that occur in the lexicon, in the scan's own tasks, and matched by an
equi-join: the lexicon is broadcast when its counted size allows it; else both
sides are shuffled by (n-gram, salt), the lexicon repeated for each of ``SALTS``
salts, so that an n-gram of a third of all texts is spread over as many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from . import spam

SALTS = 16
MAX_WORDS = 8


def words_of(text) -> Column:
    """Words of a text, lower-cased, in order."""
    return F.filter(T.word_tokens(T.lower(text)), lambda w: w != F.lit(""))


def ngrams(words: str, n: int) -> Column:
    """All n-grams of a column of words, joined by a space. Built by zipping the
    words with their own tails, so no lambda looks at another column."""
    tails = [F.expr(f"slice({words}, {k + 1}, greatest(size({words}) - {n - 1}, 0))") for k in range(n)]
    return reduce(lambda g, t: F.zip_with(g, t, lambda a, b: F.concat(a, F.lit(" "), b)), tails)


def keyword_table(lexicon: DataFrame, keyword: str = "keyword") -> tuple[DataFrame, list[int]]:
    """The lexicon with ``gram`` (its keyword's words, joined) and the lengths
    that occur; materialised. Keywords without words match nothing."""
    rows = lexicon.withColumn("_w", words_of(keyword)).withColumn("gram", F.array_join("_w", " ")).withColumn("n_words", F.size("_w")).drop("_w")
    rows = materialize(rows.where("n_words > 0"))
    lengths = sorted(r[0] for r in rows.select("n_words").distinct().limit(MAX_WORDS + 1).collect())
    if len(lengths) > MAX_WORDS:
        raise ValueError(f"keywords of more than {MAX_WORDS} different lengths")
    return rows.drop("n_words"), lengths


def match(texts: DataFrame, lexicon: DataFrame, text_col: str = "reviews", keys: tuple[str, ...] = ("review_id",)) -> DataFrame:
    """One row per text and lexicon row whose keyword the text holds: ``keys`` and
    the lexicon's columns. A NULL text holds nothing."""
    table, lengths = keyword_table(lexicon)
    if not lengths:
        return texts.select(*keys).limit(0).crossJoin(table.drop("gram").limit(0))
    grams = texts.select(*keys, words_of(text_col).alias("_w"))
    grams = grams.select(*keys, F.array_distinct(F.flatten(F.array(*[ngrams("_w", n) for n in lengths]))).alias("_g"))
    # an outer generator: no inferred filter is pushed below the input exchange
    grams = grams.select(*keys, F.explode_outer("_g").alias("gram")).where("gram is not null")
    _, _, small = spam._broadcast_if_small(table, "gram")
    if small:
        return grams.join(F.broadcast(table), "gram").drop("gram")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return grams.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")).join(salted, ["gram", "_salt"]).drop("gram", "_salt")
