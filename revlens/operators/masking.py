"""Masked training rows (TXT-5, TXT-7, PRJ-9, SNK-2).

For each review and each aspect in fixed order with a non-empty sentiment, the
first ``app`` keyword (list order) that occurs as a whole word is replaced, at
its first occurrence in the lower-cased review, by ``$T$``. Zero to six rows
per review, generated by ``inline`` over a six-element array: narrow, no
shuffle. The text is cut at the place that the keyword scan found; only the
built-in engine, which knows no places, searches with a pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import ASPECTS
from . import tagging

EXPORT_COLUMNS = ["Reviews", "Aspect", "Formatted Review", "Sentiment"]


def masked_rows(scored: DataFrame, text_col: str = "reviews", keys=("review_id",), lexicon="app") -> DataFrame:
    """Rows ``(keys..., aspect_ord, Reviews, Aspect, Formatted Review, Sentiment)``.

    ``scored`` must carry the six label columns and the text features
    (``_low``, ``_hits``) -- see :func:`revlens.plans.flow.score_reviews`."""
    at = tagging.HITS_AT if tagging.HITS_AT in scored.columns else None
    entries = []
    for i, a in enumerate(ASPECTS):
        label = F.col(a)
        masked = F.when(label != F.lit(""), tagging.mask_column(a, tagging.LOW, tagging.HITS, lexicon, at))
        entries.append(F.struct(F.lit(i).alias("aspect_ord"), F.lit(a).alias("Aspect"),
                                masked.alias("Formatted Review"), label.alias("Sentiment")))
    keep = F.filter(F.array(*entries),
                    lambda s: (s["Sentiment"] != F.lit("")) & s["Formatted Review"].isNotNull())
    return scored.select(*keys, F.col(text_col).alias("Reviews"), F.inline(keep)).select(
        *keys, "aspect_ord", *EXPORT_COLUMNS)


def export_frame(masked: DataFrame) -> DataFrame:
    """PRJ-9: the four export columns. An empty input gives an empty frame with
    this schema (the reference raises ``KeyError`` there)."""
    return masked.select(*EXPORT_COLUMNS)
