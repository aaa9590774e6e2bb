"""Exact deduplication by progressive refinement.

Texts are equal when they are identical after every run of ASCII white space
(0x20, 0x09 to 0x0D) is replaced by one space. Candidates are narrowed in
steps, each a grouping of narrow rows:

1. length of the normalised text: lengths that occur once are settled;
2. length and hash of the first ``PREFIX`` characters, only for rows whose
   length survived;
3. SHA-256 of the whole normalised text, only for rows whose (length, prefix
   hash) survived.

Texts never travel: a list of surviving keys goes to the scan when its counted
size can be broadcast; a longer one does not (the list of surviving lengths, or if
need be every row, is digested instead), and only (doc_id, digest) rows are
grouped. A group of copies of any size costs one row per task after partial
aggregation; rows without a digest take no part in a join.

Defined results: a null text equals the empty text; of equal texts the smallest
doc_id stays, null ids count as largest; rows that repeat the smallest id with
an equal text are all marked kept here (``drop_copies`` keeps one row of them);
an empty table gives no rows; the length of a text does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fits, safe_text, small_side, staged

PREFIX = 256


def normalised(text: Column) -> Column:
    """Runs of white space become one space. Only runs that are not already a
    single space are matched, so most characters are copied untouched."""
    return F.regexp_replace(text, "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def exact_dedup(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, then the
    ``keep`` columns of the input."""
    extra = [F.col(c).alias(f"x_{i}") for i, c in enumerate(keep or [])]
    names = [f"x_{i}" for i in range(len(extra))]
    rows = docs.select("doc_id", normalised(safe_text()).alias("norm"), *extra).withColumn("n", F.length("norm"))
    prefix = F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix")

    # Lengths and prefix hashes are written once; both groupings read them.
    keys = staged(rows.select("n", prefix), "dedup-keys")
    lengths = cut(keys.groupBy("n").count().where("count > 1").select("n"))
    pairs = cut(keys.join(small_side(lengths, 32), "n", "left_semi")
                .groupBy("n", "prefix").count().where("count > 1").select("n", "prefix", F.lit(True).alias("alive")))

    # The digest is evaluated only where the keys survived; all other rows are
    # already known to be the only ones of their kind. Keys too many to broadcast
    # are not joined, which would shuffle texts: lengths decide then, or nothing.
    alive = rows.withColumn("prefix", prefix)
    if fits(pairs, 48):
        alive = alive.join(F.broadcast(pairs), ["n", "prefix"], "left")
    elif fits(lengths, 32):
        alive = alive.join(F.broadcast(lengths.withColumn("alive", F.lit(True))), "n", "left")
    else:
        alive = alive.withColumn("alive", F.lit(True))
    keyed = staged(alive.select("doc_id", F.when(F.col("alive"), F.sha2(F.col("norm"), 256)).alias("digest"), *names), "dedup-digests")
    # Rows without a digest are settled and take no part in the joins.
    single = keyed.where("digest is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), *names)
    some = keyed.where("digest is not null")
    groups = cut(some.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    copied = F.col("size").isNotNull()
    found = some.join(small_side(groups, 120), "digest", "left").select(
        "doc_id", F.when(copied, F.col("first_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(copied, F.col("doc_id").eqNullSafe(F.col("first_id"))).otherwise(True).alias("kept"), *names)
    return single.unionByName(found).select(
        "doc_id", "keep_id", "group_size", "kept", *[F.col(x).alias(c) for x, c in zip(names, keep or [])])


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with one row of each group of equal texts. Where
    ids are unique, only the list of dropped ids meets the rows (broadcast, or a
    shuffle by id, which has no hot values, beyond the bound); else rows get
    numbers of their own, written with them."""
    cols = docs.columns
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    if not repeated:
        gone = cut(exact_dedup(docs).where("not kept").select(F.col("doc_id").alias("gone")))
        return docs.join(small_side(gone, 16), docs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")
    named = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), "doc_id", "text",
                               F.monotonically_increasing_id().alias("number")), "dedup-rows")
    result = exact_dedup(named, keep=["number"]).where("group_size > 1")
    digest = named.select("number", F.sha2(normalised(safe_text()), 256).alias("digest"))
    # One row number per group of copies: the first among the smallest id's rows.
    copies = staged(result.join(digest, "number"), "dedup-copies")
    first = cut(copies.where("kept").groupBy("digest").agg(F.min("number").alias("first")))
    gone = cut(copies.join(small_side(first, 80), "digest").where("number <> first").select("number"))
    return named.join(small_side(gone, 16), "number", "left_anti").select("row.*")
