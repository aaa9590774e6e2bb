"""Column-level text functions. All are built-in Spark expressions (JVM side,
no Python UDF), so they stay inside whole-stage codegen where Spark allows.


* word character = ``[\\p{L}\\p{N}_]`` (Python ``\\w`` on text), so a whole-word
  match of ``kw`` is ``(?<![\\p{L}\\p{N}_])kw(?![\\p{L}\\p{N}_])``;
* ``str.split()`` whitespace = ``(?U)[\\s\\x1c-\\x1f]+``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import literals as L
from .lexicons import is_word_keyword

WORD_CHAR = r"[\p{L}\p{N}_]"
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"
WS_RUN = r"(?U)[\s\x1c-\x1f]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_quote(s: str) -> str:
    """Regex-quote a literal for Java regex (``\\Q...\\E``)."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def word_pattern(kw: str) -> str:
    """Java regex for a whole-word occurrence of ``kw``."""
    return f"(?<!{WORD_CHAR}){java_quote(kw)}(?!{WORD_CHAR})"


def lower(c) -> Column:
    """TXT-1: ``str.lower``."""
    return F.lower(col(c))


def word_tokens(low) -> Column:
    """Maximal runs of word characters of an already lower-cased text.

    ``kw`` (made of word characters only) occurs as a whole word in the text
    iff it is one of these tokens. Empty strings at the edges are harmless
    since no keyword is empty."""
    return F.split(col(low), NON_WORD_RUN)


def ws_tokens(c) -> Column:
    """TXT-11: ``text.split()`` -- Unicode whitespace, no empty tokens, case kept."""
    return F.filter(F.split(col(c), WS_RUN), lambda x: x != F.lit(""))


def jaccard(a_tokens, b_tokens) -> Column:
    """AGG-3: |A∩B| / |A∪B| on token sets, 0 when both are empty."""
    a = F.array_distinct(col(a_tokens))
    b = F.array_distinct(col(b_tokens))
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def keyword_hits(low, words, keywords: list[str]) -> Column:
    """Keywords (from ``keywords``) that occur as whole words in ``low``.

    Single-word keywords are matched by hashing against the word tokens
    (``array_intersect``, linear in the text); the few keywords with a space
    or hyphen use a regex. Result order: single-word keywords in the given
    order, then the multi-token ones."""
    single = [k for k in keywords if is_word_keyword(k)]
    multi = [k for k in keywords if not is_word_keyword(k)]
    parts = []
    if single:
        parts.append(F.array_intersect(L.const(single), col(words)))
    if multi:
        low_c = col(low)
        # cheap substring test first; the look-around regex only on candidates
        parts.append(F.filter(F.array(*[F.when(low_c.contains(k) & low_c.rlike(word_pattern(k)), F.lit(k))
                                        for k in multi]),
                              lambda x: x.isNotNull()))
    if not parts:
        return F.array().cast("array<string>")
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def any_substring(low, keywords: list[str]) -> Column:
    """TXT-2: ``any(kw in low for kw in keywords)`` as a short-circuit OR chain
    (one SQL expression when ``low`` is a column name, else built term by term)."""
    if not keywords:
        return F.lit(False)
    quoted = [L.sql_literal(k) for k in keywords]
    if isinstance(low, str) and "`" not in low and all(q is not None for q in quoted):
        return F.expr(" OR ".join(f"contains(`{low}`, {q})" for q in quoted))
    low_c = col(low)
    out = F.lit(False)
    for k in keywords:
        out = out | low_c.contains(k)
    return out


def first_in_order(keywords: list[str], hits) -> Column:
    """SRT-5: first keyword of ``keywords`` (list order) present in ``hits``; NULL if none.

    ``array_intersect`` keeps the order of its first argument. (No lambda that
    refers to ``hits``: Catalyst may inline the producer of an outer column
    into a lambda body, which would re-run it per element.)"""
    if not keywords:
        return F.lit(None).cast("string")
    return F.get(F.array_intersect(L.const(list(keywords)), col(hits)), 0)


def mask_first(low, kw) -> Column:
    """TXT-5: replace the first whole-word occurrence of ``kw`` in ``low`` by ``$T$``.

    The pattern is built per row (``kw`` is a column); anchoring at ``^`` with a
    lazy prefix makes ``regexp_replace`` replace only the first occurrence.
    NULL when ``kw`` is NULL."""
    pattern = F.concat(F.lit(f"(?s)^(.*?)(?<!{WORD_CHAR})\\Q"), col(kw), F.lit(f"\\E(?!{WORD_CHAR})"))
    return F.when(col(kw).isNotNull(), F.regexp_replace(col(low), pattern, F.lit("$1\\$T\\$")))


def mask_at(low, kw, place) -> Column:
    """TXT-5 when the keyword's place (from 0) is known: no pattern, no search."""
    x, p = col(low), col(place)
    return F.when(col(kw).isNotNull(), F.concat(F.substring(x, F.lit(1), p), F.lit("$T$"),
                                                F.substring(x, p + F.length(col(kw)) + 1, F.length(x))))


def url_key(c) -> Column:
    """PRJ-12: percent-encode like Python ``urllib.parse.quote(s)`` (``/`` kept).

    ``url_encode`` is form encoding: space becomes ``+`` (a literal ``+`` is
    ``%2B``), ``*`` stays and ``~`` is escaped. Fix those four up."""
    e = F.url_encode(col(c))
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    e = F.replace(e, F.lit("*"), F.lit("%2A"))
    e = F.replace(e, F.lit("%7E"), F.lit("~"))
    return F.replace(e, F.lit("%2F"), F.lit("/"))


def aspect_key_col(c) -> Column:
    """TXT-10: ``aspect.lower().replace(' ', '')``."""
    return F.replace(F.lower(col(c)), F.lit(" "), F.lit(""))


# A quoted string of a Python or JSON literal, escapes included.
QUOTED = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""
_JSON_OPTIONS = {"allowBackslashEscapingAnyCharacter": "true", "allowSingleQuotes": "true"}


def parse_list_literal(c) -> Column:
    """TXT-8: parse a list literal (JSON or Python quoting); error -> empty list."""
    return F.coalesce(F.from_json(col(c), "array<string>", _JSON_OPTIONS), F.array().cast("array<string>"))


def parse_map_literal(c) -> Column:
    """TXT-9: parse a dict literal; error / other type -> empty map.

    Only text outside quotes is adapted to JSON: keys that are not strings are
    quoted (``1`` -> ``"1"``), values that are not strings (``None``, ``True``,
    numbers) become null, which scores like the reference's non-strings."""
    x = col(c)
    bare = F.split(x, QUOTED)
    bare = F.transform(bare, lambda t: F.regexp_replace(
        F.regexp_replace(t, r"([{,]\s*)([^\s'\"{}\[\],:]+)(?=\s*:)", '$1"$2"'),
        r"(:\s*)([^\s'\"{}\[\],:]+)(?=\s*[,}])", "$1null"))
    quoted = F.regexp_extract_all(x, F.lit(QUOTED), 0)
    fixed = F.array_join(F.flatten(F.zip_with(bare, quoted, lambda t, q: F.array(t, F.coalesce(q, F.lit(""))))), "")
    return F.coalesce(F.from_json(fixed, "map<string,string>", _JSON_OPTIONS),
                      F.create_map().cast("map<string,string>"))


def map_literal(keys: list[str], values: list[Column]) -> Column:
    """Render ``{'k': 'v', ...}`` the way Python's ``str(dict)`` does (no escaping
    beyond what the fixed label set needs)."""
    parts = []
    for i, (k, v) in enumerate(zip(keys, values)):
        sep = "" if i == 0 else ", "
        parts.append(F.lit(f"{sep}'{k}': '"))
        parts.append(v)
        parts.append(F.lit("'"))
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def list_literal(c) -> Column:
    """Render an array<string> like Python's ``str(list)``: ``['a', 'b']``."""
    return F.concat(F.lit("["), F.array_join(F.transform(col(c), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "),
                    F.lit("]"))


def normalise_na(c, tokens: list[str]) -> Column:
    """PRJ-3: values equal to a pandas NA token become NULL."""
    x = col(c)
    return F.when(~x.isin(*tokens), x)

