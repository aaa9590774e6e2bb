"""The ``reviews`` view derived from the driver tables.

The driver's ``documents`` hardly contain any domain vocabulary, so reviews are
built from them by plain relational code that the DuckDB oracle repeats word
for word (see :func:`reviews_sql`):

* every document becomes one review of batch ``source``: a short template
  review (chosen by ``doc_id % len(TEMPLATES)``) followed by the document's
  **whole** text;
* every Spanish document additionally yields one row of the seeded batch
  ``spam``: one token repeated ten times plus ``hospital``; every tenth such row
  also carries the document's ``source`` as an extra token;
* every French document yields one short row in each of the seeded batches
  ``SEEDS``, whose repetitive texts (picked by ``doc_id``) are settled by
  different rungs of the spam gate.

The view grows linearly with ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

# Our own short review templates. They cover every aspect, positive, negative
# and neutral wording, multi-word and hyphenated keywords, accents,
# substring-only hits and a review with no hit at all.
TEMPLATES = [
    "The nurses were kind",
    "The Doctor was rude; doctors ok",
    "Clean ICU, room access was slow",
    "Hospitals nearby are cheap",
    "Wi-Fi and air conditioning broke",
    "Bad service, worst staff",
    "édoc mdé",
    "",
    "Excellent surgeon, very professional and caring team",
    "Long queue at check-in, waited two hours",
    "Billing was expensive and the insurance desk unhelpful",
    "The washroom was dirty and smelled foul",
    "Out-of-pocket charges were reasonable, good value",
    "Great hospital with spacious rooms and clean linens",
    "Staff were polite, the receptionist was friendly",
    "Terrible experience, the doctor ignored us",
    "Quick response from the nursing staff, excellent care",
    "The ENT specialist explained the treatment well",
    "Parking was a nightmare and the cafeteria was closed",
    "Average visit, nothing special",
    "Overpriced pharmacy, rude pharmacist, slow service",
    "Spotless wards and fresh towels every day",
    "Dr. Müller was helpful; the café was crowded",
    "Amazing doctors, bad food, horrible wait",
]

SPAM_BATCH = "spam"
SPAM_TEXT = " ".join(["great"] * 10 + ["hospital"])
SPAM_LANG = "es"


SEED_LANG = "fr"


def _five(tokens: str) -> str:
    """Every token five times: a type-token ratio of 0.2."""
    return " ".join(t for t in tokens.split() for _ in range(5))


# Batch -> texts; document d gets text number d modulo their count.
SEEDS = {
    "seed_same": [_five("a")],                                               # equal sets: lower bound
    "seed_size": [_five("a"), _five("a b c d e f g h i j")],                 # sizes 1 and 10: upper bound
    "seed_split": [_five("a"), _five("b")],                                  # pair upper bound
    "seed_near": [_five(f"a b c d e f g h i v{k}") for k in range(10)],      # pair lower bound
    "seed_open": [_five("c f g h")] * 7 + [_five("c g h")] * 2 + [_five("c f h")],  # only the estimate
}


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def templates_values_sql() -> str:
    rows = ", ".join(f"({i}, {sql_str(t)})" for i, t in enumerate(TEMPLATES))
    return f"templates(t_id, t_text) AS (VALUES {rows})"


def reviews_sql() -> str:
    """CTE text (DuckDB) producing ``reviews(review_id, batch, reviews)``."""
    n = len(TEMPLATES)
    seeds = " UNION ALL ".join(
        f"SELECT -{k + 2}0000000000 - d.doc_id, '{b}', [{', '.join(sql_str(t) for t in ts)}][d.doc_id % {len(ts)} + 1] "
        f"FROM documents d WHERE d.lang = '{SEED_LANG}'" for k, (b, ts) in enumerate(SEEDS.items()))
    return f"""{templates_values_sql()},
reviews AS (
  SELECT d.doc_id AS review_id, d.source AS batch, t.t_text || ' ' || d.text AS reviews
  FROM documents d JOIN templates t ON t.t_id = d.doc_id % {n}
  UNION ALL
  SELECT -1 - d.doc_id AS review_id, '{SPAM_BATCH}' AS batch,
         '{SPAM_TEXT}' || CASE WHEN d.doc_id % 10 = 0 THEN ' ' || d.source ELSE '' END AS reviews
  FROM documents d WHERE d.lang = '{SPAM_LANG}'
  UNION ALL {seeds}
)"""


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def templates_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TEMPLATES)), "t_id INT, t_text STRING")


def reviews_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reviews(review_id BIGINT, batch STRING, reviews STRING)``."""
    docs = load_table(spark, sf_dir, "documents")
    n = len(TEMPLATES)
    # The template table has a fixed size (len(TEMPLATES) rows), so broadcasting
    # it is bounded by construction.
    base = (docs.select("doc_id", "source", "text")
            .join(F.broadcast(templates_df(spark)), F.col("t_id") == F.col("doc_id") % n)
            .select(F.col("doc_id").alias("review_id"), F.col("source").alias("batch"),
                    F.concat(F.col("t_text"), F.lit(" "), F.col("text")).alias("reviews")))
    spam = (docs.where(F.col("lang") == SPAM_LANG)
            .select((F.lit(-1) - F.col("doc_id")).alias("review_id"),
                    F.lit(SPAM_BATCH).alias("batch"),
                    F.concat(F.lit(SPAM_TEXT),
                             F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(" "), F.col("source")))
                             .otherwise(F.lit(""))).alias("reviews")))
    seeds = F.array(*[F.struct((F.lit(-(k + 2) * 10**10) - F.col("doc_id")).alias("review_id"), F.lit(b).alias("batch"),
                               F.get(F.array(*[F.lit(t) for t in ts]), F.pmod("doc_id", F.lit(len(ts))).cast("int")).alias("reviews"))
                      for k, (b, ts) in enumerate(SEEDS.items())])
    seeded = docs.where(F.col("lang") == SEED_LANG).select(F.inline(seeds))
    return spread(base.unionByName(spam).unionByName(seeded), "review_id")
