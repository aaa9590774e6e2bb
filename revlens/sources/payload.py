"""Landed review payloads (SRC-4, SRC-5, PRJ-5, PRJ-6, PRJ-10, PRJ-12).

A payload is the provider's JSON answer for one hospital query:
``{"data": [{"reviews_data": [{"author_title": .., "review_text": ..}, ..]}]}``.
Only the first element of ``data`` is used. Payloads are read from landed
files, parsed with a fixed schema and exploded -- no fetch happens here.

Two layouts, chosen explicitly: ``lines`` (what :func:`write_payloads` lands:
one payload per line, any number per file, splittable) and ``file`` (one
payload per file, possibly pretty-printed). A line or file that is not exactly
one JSON object is an error, never a shorter result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T
from ..functions.lexicons import REVIEWS_LIMIT_APP
from ..session import spread

# Items are read as maps, which keep an explicit null apart from a missing key.
ITEM = Ty.MapType(Ty.StringType(), Ty.StringType())
PAYLOAD_SCHEMA = Ty.StructType([
    Ty.StructField("hospital_name", Ty.StringType()),
    Ty.StructField("data", Ty.ArrayType(Ty.StructType([
        Ty.StructField("reviews_data", Ty.ArrayType(ITEM))])))])
LAYOUTS = ("lines", "file")


def explode_payload(df: DataFrame, payload_col: str = "payload", api_variant: bool = False,
                    strict: bool = False) -> DataFrame:
    """One row per review of ``data[0].reviews_data``: ``pos, author, reviews``
    plus the other input columns. Absent or empty ``data`` gives no rows.

    ``api_variant`` keeps only the text and turns a missing ``review_text``
    into ``""``; an explicit null stays NULL (PRJ-6). ``strict`` makes every
    payload without an entry in ``data`` an error (PRJ-10), whatever the other
    payloads hold."""
    data = F.col(payload_col)["data"]
    items = F.get(data, 0)["reviews_data"]
    if strict:
        # size(NULL) is -1 or NULL, by session setting: both count as empty.
        items = F.when(F.col(payload_col).isNull() | (F.coalesce(F.size(data), F.lit(0)) > 0), items).otherwise(
            F.raise_error("a payload holds no data").cast(Ty.ArrayType(ITEM)))
    rest = [c for c in df.columns if c != payload_col]
    out = df.select(*rest, F.posexplode(items).alias("pos", "_item"))
    text = F.col("_item")["review_text"]
    if api_variant:
        text = F.when(F.map_contains_key("_item", F.lit("review_text")), text).otherwise(F.lit(""))
        return out.select(*rest, "pos", text.alias("reviews"))
    return out.select(*rest, "pos", F.col("_item")["author_title"].alias("author"), text.alias("reviews"))


def _decode_name(c: Column) -> Column:
    """Percent-decode without form rules (``+`` stays); a name that is not a
    valid encoding is kept as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _one_payload(c: Column) -> Column:
    """Exactly one JSON object; NULL for a blank line. Parsed as the only
    element of an array, so that anything after the first object is malformed
    and raises. (Blank lines are told apart here and not only by a filter, which
    Catalyst may evaluate after the parser.)"""
    parsed = F.from_json(F.concat(F.lit("["), c, F.lit("]")), Ty.ArrayType(PAYLOAD_SCHEMA), {"mode": "FAILFAST"})
    return F.when(F.trim(c) == "", F.lit(None)).when(F.size(parsed) == 1, F.get(parsed, 0)).otherwise(
        F.raise_error("a line or file must hold exactly one payload").cast(PAYLOAD_SCHEMA))


def read_review_payloads(spark: SparkSession, path: str, layout: str = "lines",
                         api_variant: bool = False, strict: bool = False) -> DataFrame:
    """SRC-4/5: read landed payload files. The hospital name is the payload's
    own ``hospital_name`` or else the file name (``<name>.json``, percent
    encoded or plain) -- PRJ-5 over many payloads.

    ``strict`` raises for every empty payload, as the API variant does per
    request."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    raw = spark.read.text(path, wholetext=layout == "file").select("value", F.input_file_name().alias("_file"))
    if layout == "lines":
        raw = raw.where(F.trim("value") != "")
    # input_file_name() is a URI: decode once for the file name, once more for
    # the hospital name, which may be stored percent-encoded (PRJ-12 key).
    stem = F.regexp_extract("_file", r"([^/]+?)(\.jsonl?|\.txt)?$", 1)
    parsed = spread(raw).select(_decode_name(_decode_name(stem)).alias("_stem"), _one_payload(F.col("value")).alias("payload"))
    parsed = parsed.select(F.coalesce(F.col("payload.hospital_name"), F.col("_stem")).alias("hospital_name"), "payload")
    return explode_payload(parsed, "payload", api_variant, strict)


def build_payload_json(reviews: DataFrame, batch: str = "batch", key: str = "review_id",
                       text_col: str = "reviews", per_payload: int = REVIEWS_LIMIT_APP) -> DataFrame:
    """Render reviews as provider payloads: per hospital, chunks of at most
    ``per_payload`` reviews (by ``review_id``), ``author_title = 'Author <id>'``.

    Groups are bounded by construction (``floor(review_id / per_payload)``
    with unique ids), so no group grows with the data."""
    chunk = F.floor(F.col(key) / F.lit(per_payload))
    items = (reviews.select(F.col(batch).alias("hospital_name"), chunk.alias("chunk"), F.col(key).alias("_k"),
                            F.concat(F.lit("Author "), F.col(key).cast("string")).alias("author_title"),
                            F.col(text_col).alias("review_text")))
    grouped = items.groupBy("hospital_name", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("_k", "author_title", "review_text"))).alias("_items"))
    body = F.struct(F.col("hospital_name"), F.array(F.struct(F.transform(
        "_items", lambda s: F.struct(s["author_title"].alias("author_title"),
                                     s["review_text"].alias("review_text"))).alias("reviews_data"))).alias("data"))
    return grouped.select("hospital_name", "chunk", F.to_json(body).alias("payload"))


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Land payload JSON text as JSON-lines files (one payload per line; the
    hospital name travels inside the payload)."""
    payloads.select(F.col("payload").alias("value")).write.mode("overwrite").text(path)


def request_key(df: DataFrame, name_col: str = "hospital_name") -> DataFrame:
    """PRJ-12: the percent-encoded query key for each hospital name."""
    return df.withColumn("query_key", T.url_key(name_col))
