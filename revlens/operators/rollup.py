"""Aspect rollup (AGG-6..12, SRT-1/2/4, PRJ-13).

One pass over the scored reviews: six aspects x three classes as conditional
counts in a single hash aggregate (partial aggregation map-side, so a hot batch
costs one row per partition in the shuffle), then unpivoted to six rows per
group in fixed aspect order. An aspect without any scored review still yields
a row of zeros (AGG-9), without joining against an aspect table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import ASPECTS


def score(label, neutral: str = "drop") -> Column:
    """AGG-6: ``Positive`` -> 1, ``Negative`` -> -1, anything else -> NULL.

    ``neutral='drop'`` keeps the reference behaviour (``Neutral`` is never
    counted); ``neutral='count'`` scores it 0. A NULL label (a key missing from
    the map) scores 0, as a non-string does in the reference."""
    if neutral not in ("drop", "count"):
        raise ValueError("neutral must be 'drop' or 'count'")
    c = F.col(label) if isinstance(label, str) else label
    s = F.when(c.isNull(), F.lit(0)).when(c == "Positive", F.lit(1)).when(c == "Negative", F.lit(-1))
    if neutral == "count":
        s = s.when(c == "Neutral", F.lit(0))
    return s


def score_counts(scored: DataFrame, group_cols=("batch",), neutral: str = "drop",
                 label_cols: dict[str, Column] | None = None) -> DataFrame:
    """AGG-7: per group and aspect, counts of scores 1 / 0 / -1 (long form)."""
    labels = label_cols or {a: F.col(a) for a in ASPECTS}
    aggs = []
    for a in ASPECTS:
        s = score(labels[a], neutral)
        aggs += [F.count_if(s == 1).alias(f"{a}__p"), F.count_if(s == 0).alias(f"{a}__u"),
                 F.count_if(s == -1).alias(f"{a}__n")]
    wide = scored.groupBy(*group_cols).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("aspect_ord"), F.lit(a).alias("Aspect"),
                              F.col(f"{a}__p").alias("n_pos"), F.col(f"{a}__u").alias("n_neu"),
                              F.col(f"{a}__n").alias("n_neg"))
                     for i, a in enumerate(ASPECTS)])
    return wide.select(*group_cols, F.inline(rows))


def percentages(counts: DataFrame) -> DataFrame:
    """AGG-8 + AGG-10: percentages ``(count / total) * 100`` (0 when no score),
    dominant class (ties: Positive, Neutral, Negative), signed as a number and as
    the reference's string."""
    total = F.col("n_pos") + F.col("n_neu") + F.col("n_neg")

    def pct(c):
        return F.when(total > 0, F.col(c) / total * F.lit(100)).otherwise(F.lit(0.0))

    out = (counts.withColumn("Positive", pct("n_pos"))
                 .withColumn("Neutral", pct("n_neu"))
                 .withColumn("Negative", pct("n_neg")))
    m = F.greatest("Positive", "Neutral", "Negative")
    neg_wins = (F.col("Negative") == m) & (F.col("Positive") < m) & (F.col("Neutral") < m)
    out = out.withColumn("signed_pct", F.when(neg_wins, -m).otherwise(m))
    return out.withColumn("Sentiment", F.col("signed_pct").cast("string"))


def aspect_rollup(scored: DataFrame, group_cols=("batch",), neutral: str = "drop",
                  label_cols: dict[str, Column] | None = None) -> DataFrame:
    """AGG-11: the rollup table, six rows per group in fixed aspect order."""
    out = percentages(score_counts(scored, group_cols, neutral, label_cols))
    return out.select(*group_cols, "aspect_ord", "Aspect", "Positive", "Neutral", "Negative",
                      "Sentiment", "signed_pct")


def one_decimal(v) -> Column:
    """``format(v, '.1f')`` of a double: the nearest tenth of its exact binary
    value, ties to even. Java and Spark round the shortest decimal form instead
    (66.55 is stored as 66.5499..., which ``bround`` turns into 66.6).

    All in integers: the fraction of ``v`` scaled by 2^58 is exact (below 1/64
    it is cut off, far from any tie), and twenty times it still fits a BIGINT;
    its whole part counts half tenths, the rest tells a tie from more."""
    c = F.col(v) if isinstance(v, str) else v
    a = F.abs(c)
    whole = F.floor(a)
    halves = ((a - whole) * F.lit(2.0 ** 58)).cast("bigint") * F.lit(20)
    k = F.shiftright(halves, 58)
    rest = halves - F.shiftleft(k, 58)
    tenth = F.shiftright(k, 1)
    up = (k.bitwiseAND(F.lit(1)) == 1) & ((rest > 0) | (tenth.bitwiseAND(F.lit(1)) == 1))
    total = whole.cast("bigint") * 10 + tenth + up.cast("bigint")
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(total / 10).cast("string"), F.lit("."), (total % 10).cast("string"))


def chart_feed(rollup: DataFrame, group_cols=("batch",)) -> DataFrame:
    """PRJ-13: bar value, colour, ``.1f`` label, alignment and label position."""
    v = F.col("signed_pct")
    pos = v >= 0
    return rollup.select(
        *group_cols, "aspect_ord", "Aspect", v.alias("value"),
        F.when(pos, F.lit("green")).otherwise(F.lit("red")).alias("color"),
        one_decimal(v).alias("label"),
        F.when(pos, F.lit("left")).otherwise(F.lit("right")).alias("align"),
        (v + F.when(pos, F.lit(0.01)).otherwise(F.lit(-0.01))).alias("label_x"))
