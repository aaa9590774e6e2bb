"""

Every query reads the driver tables (through the derived ``reviews`` view or
directly) over whole tables and whole texts; each takes ``(spark, sf_dir)`` and
returns a DataFrame (queries behind the spam gate, files or streams run those
steps when called). Column names match the DuckDB twins in
:mod:`revlens.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import ASPECTS, JSON_LEXICON, NA_TOKENS, REVIEWS_LIMIT_APP, dedupe
from ..operators import fitted, lexicon_join, masking, positions, rollup, scoring, spam, substring_join, tagging
from ..session import staging_path
from ..sources import ordered, payload, reviews
from ..streaming import gate, stream
from . import flow
from .derived import TEMPLATES, load_table, reviews_view, templates_df


def _nn(spark, sf_dir) -> DataFrame:
    return flow.drop_null_reviews(reviews_view(spark, sf_dir))


def _clean(spark, sf_dir) -> DataFrame:
    return flow.clean_reviews(reviews_view(spark, sf_dir))


def _join_arr(c, sep="|"):
    return F.array_join(c, sep)


# --- tagging / matching -----------------------------------------------------

def q_aspect_gate_substring(spark, sf_dir):
    df = tagging.with_text_features(_nn(spark, sf_dir), "reviews", keywords=[])
    gates = tagging.gates_from_mask()
    return df.select("review_id", "batch", *[gates[a].alias(f"g_{a}") for a in ASPECTS])


def q_aspect_tags(spark, sf_dir):
    tagged = tagging.tag_aspects(_nn(spark, sf_dir))
    return tagged.select("review_id", _join_arr(F.col("Aspects")).alias("aspects"),
                         _join_arr(F.col("`Matched Keywords`")).alias("matched_keywords"),
                         F.size("Aspects").alias("n_tags"))


def q_aspects_distinct(spark, sf_dir):
    kws = dedupe([k for v in JSON_LEXICON.values() for k in v])
    df = tagging.with_text_features(_nn(spark, sf_dir), "reviews", kws)
    return df.select("review_id", _join_arr(tagging.distinct_aspects(tagging.HITS, "json")).alias("aspects"))


def _tag_rows(spark, sf_dir):
    kws = dedupe([k for v in JSON_LEXICON.values() for k in v])
    df = tagging.with_text_features(_nn(spark, sf_dir), "reviews", kws)
    return df.select("review_id", F.inline(tagging.tag_structs(tagging.HITS, "json")))


def q_keyword_counts(spark, sf_dir):
    return (_tag_rows(spark, sf_dir).groupBy("aspect", "keyword")
            .agg(F.count(F.lit(1)).alias("n_reviews")))


def q_aspect_key_counts(spark, sf_dir):
    rows = _tag_rows(spark, sf_dir).select("review_id", "aspect").distinct()
    return (rows.groupBy(T.aspect_key_col("aspect").alias("aspect_key"))
            .agg(F.count(F.lit(1)).alias("n_reviews")))


# --- spam gate --------------------------------------------------------------

def q_ttr_per_review(spark, sf_dir):
    st = spam.review_token_stats(_nn(spark, sf_dir))
    return st.select("review_id", "batch", "n_tokens", "n_distinct", "ttr")


def q_batch_ttr(spark, sf_dir):
    return spam.batch_ttr(spam.review_token_stats(_nn(spark, sf_dir)))


def q_batch_jaccard_bounds(spark, sf_dir):
    b = spam.jaccard_bounds(spam.review_token_stats(_nn(spark, sf_dir)))
    return b.select("batch", "n", F.round("jaccard_lo", 6).alias("jaccard_lo"),
                    F.round("jaccard_hi", 6).alias("jaccard_hi"))


def q_batch_jaccard_estimate(spark, sf_dir):
    e = spam.jaccard_estimate(spam.review_token_stats(_nn(spark, sf_dir)), whole=True)
    return e.select("batch", "n", F.round("jaccard_est", 6).alias("jaccard_est"), F.round("jaccard_se", 6).alias("jaccard_se"))


def q_batch_jaccard_pair_bounds(spark, sf_dir):
    b = spam.pair_bounds(spam.review_token_stats(_nn(spark, sf_dir)))
    return b.select("batch", "n", F.round("pair_lo", 6).alias("pair_lo"), F.round("pair_hi", 6).alias("pair_hi"))


def q_spam_gate(spark, sf_dir):
    """AGG-5 as the pipeline runs it: later rungs only for batches still open."""
    return spam.spam_gate(_nn(spark, sf_dir))


def q_spam_gate_exact(spark, sf_dir):
    """The gate's verdicts; the twin applies the rule to the exact mean over
    all pairs."""
    return spam.spam_gate(_nn(spark, sf_dir), report=False).select("batch", "n", "avg_ttr", "is_spam")


def q_clean_reviews(spark, sf_dir):
    return _clean(spark, sf_dir).select("review_id", "batch", F.length("reviews").alias("n_chars"))


# --- scoring ----------------------------------------------------------------

def q_sentiment_long(spark, sf_dir):
    sc = flow.score_reviews(_nn(spark, sf_dir), keep_features=False)
    lg = scoring.sentiment_long(sc)
    return lg.select("review_id", "aspect_ord", "aspect",
                     F.col("logits")[0].alias("logit_neg"), F.col("logits")[1].alias("logit_neu"),
                     F.col("logits")[2].alias("logit_pos"),
                     F.round(scoring.confidence("logits"), 6).alias("confidence"), "sentiment")


def q_sentiment_map(spark, sf_dir):
    sc = flow.score_reviews(_nn(spark, sf_dir), keep_features=False)
    n_gated = sum((F.col(a) != F.lit("")).cast("int") for a in ASPECTS)
    return sc.select("review_id", *ASPECTS, n_gated.alias("n_gated"),
                     F.size("sentiment").alias("n_keys"))


def _every_third(c: int):
    return lambda x, i: i % 3 == c


def q_logits_to_label(spark, sf_dir):
    emb = load_table(spark, sf_dir, "embeddings")
    # All components count: the three logits are the sums of every third one.
    e = F.col("embedding").cast("array<double>")
    lg = F.array(*[F.aggregate(F.filter(e, _every_third(c)), F.lit(0.0), lambda a, x: a + x) for c in range(3)])
    return emb.select("vec_id", scoring.label_from_logits(lg).alias("label"),
                      F.round(scoring.confidence(lg), 6).alias("confidence"))


# --- rollup -----------------------------------------------------------------

def _scored_clean(spark, sf_dir):
    return flow.score_reviews(_clean(spark, sf_dir), keep_features=False)


def q_score_counts(spark, sf_dir):
    return rollup.score_counts(_scored_clean(spark, sf_dir), ("batch",), "drop")


def q_aspect_rollup(spark, sf_dir):
    return rollup.aspect_rollup(_scored_clean(spark, sf_dir), ("batch",), "drop")


def q_aspect_rollup_neutral(spark, sf_dir):
    return rollup.aspect_rollup(_scored_clean(spark, sf_dir), ("batch",), "count")


def q_aspect_rollup_total(spark, sf_dir):
    return rollup.aspect_rollup(_scored_clean(spark, sf_dir), (), "drop")


def q_chart_feed(spark, sf_dir):
    return rollup.chart_feed(rollup.aspect_rollup(_scored_clean(spark, sf_dir), ("batch",), "drop"), ("batch",))


# --- export -----------------------------------------------------------------

def q_masked_rows(spark, sf_dir):
    sc = flow.score_reviews(_clean(spark, sf_dir))
    return masking.masked_rows(sc, keys=("review_id",))


# Literals that are broken, not a dict, or hold values that are not strings.
ODD_LITERALS = ["oops", "['doctor']", "{'doctor': None, 'cost': 'x: None}'}", "{1: 'a', 'staff': True}"]


def q_parse_literals(spark, sf_dir):
    """TXT-8/9, PRJ-7: reviews annotated the way the staging CSV stores them
    (Python literals), parsed back. For every seventh review there is one more
    row (negative id) whose sentiment literal is an odd one."""
    sc = flow.score_reviews(_nn(spark, sf_dir))
    sc = sc.withColumn("_tags", tagging.tag_structs(tagging.HITS, "json"))
    lit_aspects = T.list_literal(F.transform("_tags", lambda s: s["aspect"]))
    good = sc.select("review_id", lit_aspects.alias("aspects_literal"),
                     T.map_literal(ASPECTS, [F.col(a) for a in ASPECTS]).alias("sentiment_literal"))
    nth = F.pmod(F.floor(F.abs("review_id") / 7), F.lit(len(ODD_LITERALS))).cast("int")
    odd = (_nn(spark, sf_dir).where(F.abs("review_id") % 7 == 3)
           .select((F.lit(-10**12) - F.col("review_id")).alias("review_id"), F.lit("[oops").alias("aspects_literal"),
                   F.get(F.array(*[F.lit(x) for x in ODD_LITERALS]), nth).alias("sentiment_literal")))
    m = T.parse_map_literal("sentiment_literal")
    return good.unionByName(odd).select(
        "review_id", F.size(T.parse_list_literal("aspects_literal")).alias("n_aspects"), F.size(m).alias("n_sentiments"),
        *[F.try_element_at(m, F.lit(a)).alias(f"s_{a}") for a in ASPECTS])


# --- sources / keys ---------------------------------------------------------

def q_payload_explode(spark, sf_dir):
    """SRC-4/5, PRJ-5/6: review payloads of up to 100 reviews each (as the
    provider returns them), rendered to JSON and read back."""
    rv = _nn(spark, sf_dir)
    docs = payload.build_payload_json(rv)
    out = payload.explode_payload(docs.select("hospital_name", F.from_json("payload", payload.PAYLOAD_SCHEMA)
                                              .alias("payload"), "chunk"))
    return out.select("hospital_name", "chunk", "pos", F.col("author").alias("author"),
                      F.col("reviews").alias("reviews"))


def q_payload_files(spark, sf_dir):
    """SRC-4/5, SNK: payload files landed in the shared folder, several payloads
    per file, and read back with the reader."""
    path = staging_path(spark, "payloads")
    payload.write_payloads(payload.build_payload_json(_nn(spark, sf_dir)), path)
    return payload.read_review_payloads(spark, path, strict=True).select("hospital_name", "author", "reviews")


def q_csv_roundtrip(spark, sf_dir):
    """SRC-1, SNK-2, PRJ-3: reviews (some cells NA tokens) written as result CSV
    and read back with the reader."""
    path = staging_path(spark, "csv")
    rows = reviews_view(spark, sf_dir).select("review_id", "batch", F.when(_odd_cell(), _na_token()).otherwise(F.col("reviews")).alias("Reviews"))
    reviews.write_results_csv(rows, path)
    back = reviews.read_reviews_csv(spark, path)
    return back.select(F.col("review_id").cast("bigint").alias("review_id"), "batch", F.col("Reviews").alias("reviews"))


def q_xlsx_roundtrip(spark, sf_dir):
    """SRC-2, PRJ-3: every document as a review in workbooks of a hundred (texts,
    truth values, NA tokens), written and read back with the workbook reader."""
    path = staging_path(spark, "workbooks")
    docs = load_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("Id"), (F.col("doc_id") % 3 == 0).alias("Urgent"),
        F.when(F.col("doc_id") % 13 == 4, F.lit("n/a")).otherwise(F.col("text")).alias("Reviews"))
    reviews.write_workbooks(docs, path, ["Id", "Reviews", "Urgent"], key="doc_id")
    back = reviews.workbook_rows(spark.read.parquet(path))
    return back.select(F.col("Id").cast("bigint").alias("doc_id"), "Urgent", F.col("Reviews").alias("reviews"), "source_file")


def _data_lexicon(spark, sf_dir) -> DataFrame:
    """A lexicon that grows with the tables: every word of the benchmark's texts
    and the first two words of every document."""
    words = lexicon_join.words_of("text")
    # Cut off after three parts: the first may be empty.
    first = F.filter(F.slice(F.split(F.lower("text"), T.NON_WORD_RUN, 4), 1, 3), lambda w: w != F.lit(""))
    bench = load_table(spark, sf_dir, "benchmark").select(F.explode(words).alias("keyword")).select(F.lit("benchmark").alias("aspect"), "keyword")
    opening = load_table(spark, sf_dir, "documents").select(F.lit("opening").alias("aspect"), F.array_join(F.slice(first, 1, 2), " ").alias("keyword"))
    return bench.unionByName(opening).where("keyword <> ''").distinct()


def q_lexicon_hits(spark, sf_dir):
    """SRC-6, JON-1: reviews that hold each keyword of a lexicon given as data."""
    hits = lexicon_join.match(_nn(spark, sf_dir), _data_lexicon(spark, sf_dir))
    return hits.groupBy("aspect", "keyword").agg(F.count(F.lit(1)).alias("n_reviews"))


def q_substring_hits(spark, sf_dir):
    """SRC-6, JON-2: reviews that hold each keyword of a lexicon given as data
    anywhere in their text, inside words too."""
    hits = substring_join.match(_nn(spark, sf_dir), _data_lexicon(spark, sf_dir))
    return hits.groupBy("aspect", "keyword").agg(F.count(F.lit(1)).alias("n_reviews"))


def q_attach_by_position(spark, sf_dir):
    """JON-4, SRC-8: lengths attached to the reviews by their position alone."""
    rows = _nn(spark, sf_dir)
    left = positions.with_position(rows.select("review_id", "batch"), "review_id")
    right = positions.with_position(rows.select("review_id", F.length("reviews").alias("n_chars")), "review_id").drop("review_id")
    return positions.attach(left, right).select("position", "review_id", "batch", "n_chars")


def _odd_cell():
    return F.abs("review_id") % 11 == 5


def _na_token():
    nth = F.pmod(F.floor(F.abs("review_id") / 11), F.lit(len(NA_TOKENS))).cast("int")
    return F.get(F.array(*[F.lit(t) for t in NA_TOKENS]), nth)


def q_masked_export(spark, sf_dir):
    """PRJ-9, SNK-2: the masked export written as CSV and read back, counted
    per aspect and sentiment with the lengths of its texts."""
    path = staging_path(spark, "export")
    reviews.write_results_csv(masking.export_frame(q_masked_rows(spark, sf_dir)), path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return (back.groupBy("Aspect", "Sentiment")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("Reviews")).alias("review_chars"),
                 F.sum(F.length("`Formatted Review`")).alias("masked_chars")))


def q_template_jaccard_whole(spark, sf_dir):
    """AGG-3: every review of a document against the whole template that it
    begins with (the seeded batches have no template)."""
    rows = (_nn(spark, sf_dir).where("review_id >= 0")
            .join(F.broadcast(templates_df(spark)), F.col("t_id") == F.col("review_id") % len(TEMPLATES)))
    return rows.select("review_id", F.round(T.jaccard(T.ws_tokens("reviews"), T.ws_tokens("t_text")), 9).alias("jaccard"))


def q_sentiment_truncated(spark, sf_dir):
    """SCR-3: the scorer sees the first 64 words only."""
    sc = flow.score_reviews(_nn(spark, sf_dir), scoring.LinearScorer(max_tokens=64), keep_features=False)
    return scoring.sentiment_long(sc).select("review_id", "aspect", F.col("logits")[0].alias("logit_neg"),
                                             F.col("logits")[1].alias("logit_neu"), F.col("logits")[2].alias("logit_pos"), "sentiment")


def length_models() -> dict:
    """Models for two aspects, by text length; the other aspects have none."""
    return {a: (lambda texts, k=k: [[float((len(t) + k) % 3 == c) for c in range(3)] for t in texts])
            for k, a in enumerate(ASPECTS[:2])}


def q_model_labels(spark, sf_dir):
    """SCR-2, SCR-4: a model scorer that lacks models for some aspects."""
    sc = flow.score_reviews(_nn(spark, sf_dir), scoring.ModelScorer(length_models), keep_features=False)
    return sc.select("review_id", *ASPECTS)


def q_fitted_labels(spark, sf_dir):
    """SCR-2(b): naive Bayes per aspect, fitted on the linear scorer's labels of all
    reviews, saved, loaded and applied to all reviews."""
    rows = _nn(spark, sf_dir)
    folder = staging_path(spark, "models")
    fitted.save(fitted.fit(flow.score_reviews(rows, keep_features=False)), folder)
    sc = flow.score_reviews(rows, fitted.scorer(fitted.load(spark, folder)), keep_features=False)
    return scoring.sentiment_long(sc).select(
        "review_id", "aspect", *[F.round(F.col("logits")[i], 3).alias(f"log_{c}") for i, c in enumerate(("neg", "neu", "pos"))], "sentiment")


def q_ordered_export(spark, sf_dir):
    """SNK-2, TXT-7: the masked export in the order of review and aspect over all
    of its files, read back with every row's place."""
    path = staging_path(spark, "ordered")
    clean = _clean(spark, sf_dir).select("review_id", "reviews")
    ordered.write_ordered_csv(clean, path, ["review_id"], masking.EXPORT_COLUMNS,
                              expand=lambda rows: masking.masked_rows(flow.score_reviews(rows)))
    return ordered.read_ordered_csv(spark, path)


def _landed(spark, sf_dir) -> str:
    path = staging_path(spark, "stream-source")
    _nn(spark, sf_dir).select("review_id", "batch", "reviews").write.json(path)
    return path


def q_stream_predict(spark, sf_dir):
    """STR-1: landed files through the prediction stream, sink read back."""
    sink = staging_path(spark, "stream-predict")
    stream.start_prediction_query(spark, _landed(spark, sf_dir), sink, available_now=True).awaitTermination()
    return spark.read.parquet(sink).select("review_id", *ASPECTS)


def q_stream_rollup(spark, sf_dir):
    """STR-2: the running rollup after the stream has seen all files."""
    table = staging_path(spark, "stream-rollup")
    stream.start_rollup_query(spark, _landed(spark, sf_dir), table, available_now=True).awaitTermination()
    return stream.current_rollup(spark, table)


def q_stream_gate(spark, sf_dir):
    """AGG-1..5 on the stream: the gate's state after the stream has seen all
    files, a few files a micro-batch."""
    table = staging_path(spark, "stream-gate")
    stream.start_gate_query(spark, _landed(spark, sf_dir), table, available_now=True, max_files_per_trigger=8).awaitTermination()
    return gate.current_gate(spark, table)


def q_stream_review_limit(spark, sf_dir):
    """SRT-3 on the stream: the first reviews of every hospital after the stream
    has seen all files, a few files a micro-batch."""
    table = staging_path(spark, "stream-limit")
    stream.start_limit_query(spark, _landed(spark, sf_dir), table, available_now=True, max_files_per_trigger=8).awaitTermination()
    return stream.current_first(spark, table).select("batch", "review_id", "rank", F.length("reviews").alias("n_chars"))


def q_review_limit(spark, sf_dir):
    """SRT-3: the first 100 reviews per hospital (provider limit)."""
    w = Window.partitionBy("batch").orderBy("review_id")
    return (_nn(spark, sf_dir).select("batch", "review_id", F.row_number().over(w).alias("rank"))
            .where(F.col("rank") <= REVIEWS_LIMIT_APP))


def q_request_url(spark, sf_dir):
    pages = load_table(spark, sf_dir, "pages")
    return pages.select("page_id", T.url_key("url").alias("url_key"))


# Hospital names with everything that percent-encoding treats differently.
ODD_NAMES = ["St. Mary's Hospital", "A+ Care", "50% Clinic", "Clínica São José", "a~b*c", "x/y z", "日本 病院", "R&D; (north)"]


def q_request_name(spark, sf_dir):
    """PRJ-12: query keys of hospital names with spaces, accents and marks."""
    docs = load_table(spark, sf_dir, "documents")
    name = F.concat_ws(" ", F.get(F.array(*[F.lit(x) for x in ODD_NAMES]), F.pmod("doc_id", F.lit(len(ODD_NAMES))).cast("int")), "source")
    return payload.request_key(docs.select("doc_id", name.alias("hospital_name"))).select("doc_id", "hospital_name", "query_key")


def _cells(spark, sf_dir):
    """Conversation texts with every fifth row's cell an NA token."""
    conv = load_table(spark, sf_dir, "conversations")
    at = F.col("conv_id") * 31 + F.col("turn")
    token = F.get(F.array(*[F.lit(t) for t in NA_TOKENS]), F.pmod(F.floor(at / 5), F.lit(len(NA_TOKENS))).cast("int"))
    return conv.select("conv_id", "turn", "role", F.when(at % 5 == 0, token).otherwise(F.col("text")).alias("text"))


def q_na_normalise(spark, sf_dir):
    """PRJ-2/3: pandas NA tokens become NULL; count what survives per role."""
    return (_cells(spark, sf_dir).select("role", T.normalise_na("text", NA_TOKENS).alias("text"))
            .groupBy("role").agg(F.count(F.lit(1)).alias("n_rows"), F.count("text").alias("n_text")))


def q_nan_cells(spark, sf_dir):
    """PRJ-4: NULL cells kept as the text ``nan``."""
    cells = _cells(spark, sf_dir).withColumn("text", T.normalise_na("text", NA_TOKENS))
    return reviews.stringify(cells, "text", keep_nulls_as_nan=True).select("conv_id", "turn", "text")


QUERIES = {
    "aspect_gate_substring": q_aspect_gate_substring,
    "aspect_tags": q_aspect_tags,
    "aspects_distinct": q_aspects_distinct,
    "keyword_counts": q_keyword_counts,
    "aspect_key_counts": q_aspect_key_counts,
    "ttr_per_review": q_ttr_per_review,
    "batch_ttr": q_batch_ttr,
    "batch_jaccard_bounds": q_batch_jaccard_bounds,
    "batch_jaccard_estimate": q_batch_jaccard_estimate,
    "batch_jaccard_pair_bounds": q_batch_jaccard_pair_bounds,
    "spam_gate": q_spam_gate,
    "spam_gate_exact": q_spam_gate_exact,
    "clean_reviews": q_clean_reviews,
    "sentiment_long": q_sentiment_long,
    "sentiment_map": q_sentiment_map,
    "logits_to_label": q_logits_to_label,
    "score_counts": q_score_counts,
    "aspect_rollup": q_aspect_rollup,
    "aspect_rollup_neutral": q_aspect_rollup_neutral,
    "aspect_rollup_total": q_aspect_rollup_total,
    "chart_feed": q_chart_feed,
    "masked_rows": q_masked_rows,
    "parse_literals": q_parse_literals,
    "payload_explode": q_payload_explode,
    "review_limit": q_review_limit,
    "request_url": q_request_url,
    "request_name": q_request_name,
    "payload_files": q_payload_files,
    "csv_roundtrip": q_csv_roundtrip,
    "xlsx_roundtrip": q_xlsx_roundtrip,
    "lexicon_hits": q_lexicon_hits,
    "substring_hits": q_substring_hits,
    "attach_by_position": q_attach_by_position,
    "masked_export": q_masked_export,
    "template_jaccard_whole": q_template_jaccard_whole,
    "sentiment_truncated": q_sentiment_truncated,
    "model_labels": q_model_labels,
    "stream_predict": q_stream_predict,
    "stream_rollup": q_stream_rollup,
    "stream_gate": q_stream_gate,
    "stream_review_limit": q_stream_review_limit,
    "fitted_labels": q_fitted_labels,
    "ordered_export": q_ordered_export,
    "nan_cells": q_nan_cells,
    "na_normalise": q_na_normalise,
}
