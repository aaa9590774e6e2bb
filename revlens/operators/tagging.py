"""Aspect gating, tagging and masking (TXT-1..7, JON-1/2/5, SRT-5).

Everything here is a narrow projection: one pass over each review, no join, no
shuffle. Two engines find the keywords in the lower-cased text:

* ``automaton`` (default) -- one Aho-Corasick pass per review in an
  Arrow-batched pandas UDF (:mod:`.matcher`), giving the substring gates and all
  whole-word hits at once; needs ``pyahocorasick`` on the executors;
* ``jvm`` -- built-in expressions only: word tokens hash-intersected with the
  keyword set, a ``contains`` chain per aspect for the gate, and a regex for
  the few multi-token keywords.

Both give the same ``_gate_mask`` and ``_hits`` columns. The engine is the
caller's choice and never changes by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import literals as L
from ..functions import text as T
from ..functions.lexicons import (ASPECTS, all_keywords, dedupe, get_lexicon,
                                  reduce_for_substring)
from . import matcher

LOW = "_low"
WORDS = "_words"
HITS = "_hits"
# Where each hit first occurs; only the automaton gives it.
HITS_AT = "_hits_at"
PRESENT = "_present"
GATE_MASK = "_gate_mask"


DEFAULT_ENGINE = "automaton"


def gate_columns(low=LOW, lexicon="api") -> dict[str, Column]:
    """TXT-2 / JON-2 with built-in expressions: per aspect, does any keyword
    occur as a substring? Uses the reduced lexicon (R1), which gives the same ``any``."""
    lex = get_lexicon(lexicon)
    return {a: T.any_substring(low, reduce_for_substring(lex.get(a, []))) for a in ASPECTS}


def gates_from_mask(mask=GATE_MASK) -> dict[str, Column]:
    return {a: (T.col(mask).bitwiseAND(F.lit(1 << i)) != 0) for i, a in enumerate(ASPECTS)}


def with_text_features(df: DataFrame, text_col: str = "reviews", keywords: list[str] | None = None,
                       vocab: list[str] | None = None, gate_lexicon="api", engine: str | None = None) -> DataFrame:
    """Add ``_low`` (lower-cased text), ``_gate_mask`` (substring gate per
    aspect, bit i = ``ASPECTS[i]``), ``_hits`` (whole-word keyword hits) and,
    with ``vocab``, ``_present`` (distinct vocabulary words, for the linear scorer)."""
    engine = engine or DEFAULT_ENGINE
    kws = dedupe(list(keywords if keywords is not None else all_keywords()) + list(vocab or []))
    lex = get_lexicon(gate_lexicon)
    out = df.withColumn(LOW, T.lower(text_col))
    if engine == "automaton":
        gate_kws = [reduce_for_substring(lex.get(a, [])) for a in ASPECTS]
        out = (out.withColumn("_scan", matcher.scan_column(df.sparkSession, F.col(LOW), gate_kws, kws))
                  .withColumn(GATE_MASK, F.col("_scan.gate_mask"))
                  .withColumn(HITS, F.col("_scan.hits"))
                  .withColumn(HITS_AT, F.col("_scan.at")).drop("_scan"))
    elif engine == "jvm":
        gates = gate_columns(LOW, lex)
        mask = sum(F.when(gates[a], F.lit(1 << i)).otherwise(F.lit(0)) for i, a in enumerate(ASPECTS))
        out = (out.withColumn(WORDS, T.word_tokens(LOW))
                  .withColumn(HITS, T.keyword_hits(LOW, WORDS, kws))
                  .withColumn(GATE_MASK, mask).drop(WORDS))
    else:
        raise ValueError("engine must be 'automaton' or 'jvm'")
    if vocab is not None:
        out = out.withColumn(PRESENT, F.array_intersect(L.const(list(vocab), "array<string>"), F.col(HITS)))
    return out


def tag_structs(hits=HITS, lexicon="json") -> Column:
    """TXT-4: ``array<struct<aspect, keyword>>`` -- one entry per matched keyword
    (list duplicates included), in lexicon order (aspect order, then keyword order).

    Matched distinct keywords -> their entry positions (literal map) -> sorted ->
    entries. Lambdas only touch literals, never an outer column."""
    lex = get_lexicon(lexicon)
    entries = [(a, k) for a, kws in lex.items() for k in kws]
    positions: dict[str, list[int]] = {}
    for i, (_, k) in enumerate(entries):
        positions.setdefault(k, []).append(i)
    if not entries:
        return F.array().cast("array<struct<aspect:string,keyword:string>>")
    kw_order = list(positions)
    pos_map = L.const({k: positions[k] for k in kw_order})
    ent = L.struct_array(entries, ("aspect", "keyword"))
    matched = F.array_intersect(L.const(kw_order), T.col(hits))
    idx = F.array_sort(F.flatten(F.transform(matched, lambda k: F.element_at(pos_map, k))))
    return F.transform(idx, lambda i: F.element_at(ent, i + 1))


def tag_aspects(df: DataFrame, text_col: str = "reviews", lexicon="json") -> DataFrame:
    """TXT-4: add ``Aspects`` and ``Matched Keywords`` (parallel arrays)."""
    lex = get_lexicon(lexicon)
    kws = dedupe([k for v in lex.values() for k in v])
    out = with_text_features(df, text_col, kws).withColumn("_tags", tag_structs(HITS, lex))
    return (out.withColumn("Aspects", F.transform("_tags", lambda s: s["aspect"]))
               .withColumn("Matched Keywords", F.transform("_tags", lambda s: s["keyword"]))
               .drop("_tags", LOW, HITS, HITS_AT, GATE_MASK))


def distinct_aspects(hits=HITS, lexicon="json") -> Column:
    """TXT-3: aspects with at least one whole-word hit, in lexicon order."""
    lex = get_lexicon(lexicon)
    flags = [F.when(F.arrays_overlap(T.col(hits), L.const(list(kws))), F.lit(a))
             for a, kws in lex.items() if kws]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def first_keyword(aspect: str, hits=HITS, lexicon="app") -> Column:
    """SRT-5: first keyword of the aspect's list (list order) that matched."""
    return T.first_in_order(dedupe(get_lexicon(lexicon).get(aspect, [])), hits)


def mask_column(aspect: str, low=LOW, hits=HITS, lexicon="app", at: str | None = None) -> Column:
    """TXT-5: masked lower-cased review for one aspect; NULL if no keyword
    matched. With ``at`` (first places of the hits) the text is cut there; without
    it the place is searched with a pattern."""
    kw = first_keyword(aspect, hits, lexicon)
    return T.mask_first(low, kw) if at is None else T.mask_at(low, kw, F.get(T.col(at), F.array_position(T.col(hits), kw).cast("int") - 1))
