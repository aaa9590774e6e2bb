"""Registered queries: each applies one operator, with production parameters,
to its whole table and derives the columns of its contract from the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (chat, exact_dedup, hyperminhash, licenses, merkle, packing, prefix_trie, quality, sentencepiece_scan, spelling, substrings,
               token_files, toxicity)
from .common import load, safe_text


def op1_quality(spark, sf_dir):
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_chat_format(spark, sf_dir):
    # The contract's own conversation: control strings inside both texts.
    text = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    talks = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_conversations(talks))


def op3_exact_dedup(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    digest = F.sha2(exact_dedup.normalised(safe_text()), 256)
    return exact_dedup.exact_dedup(docs.select("doc_id", "text", digest.alias("text_sha256")), keep=["text_sha256"])


def op4_toxicity(spark, sf_dir):
    return toxicity.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_packing(spark, sf_dir):
    return (packing.pack(load(spark, sf_dir, "documents"))
            .select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"))


def op6_fingerprints(spark, sf_dir):
    return merkle.compare_with_next(load(spark, sf_dir, "documents"))


def op7_token_files(spark, sf_dir):
    path = token_files.write(load(spark, sf_dir, "documents"))
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_near_dedup(spark, sf_dir):
    return hyperminhash.near_dedup(load(spark, sf_dir, "documents"), hyperminhash.Rule(shingle=3, percent=85, band=5))


def op9_sentencepiece(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    encoded = sentencepiece_scan.encode(docs).withColumn("ids_crc32", F.crc32("ids"))
    back = sentencepiece_scan.decode(encoded.withColumn("n_pieces", F.floor(F.length("ids") / 4)), keep=["n_chunks", "n_pieces", "ids_crc32"])
    return back.select("doc_id", "n_chunks", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op10_licenses(spark, sf_dir):
    return licenses.scan(load(spark, sf_dir, "documents"))


def op11_substring_dedup(spark, sf_dir):
    return (substrings.substring_dedup(load(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))


def op12_spelling(spark, sf_dir):
    return spelling.group_variants(spelling.vocabulary(load(spark, sf_dir, "documents"), noise=31))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(load(spark, sf_dir, "conversations")).drop("node", "parent")


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_chat_format, op3_exact_dedup, op4_toxicity, op5_packing, op6_fingerprints, op7_token_files,
    op8_near_dedup, op9_sentencepiece, op10_licenses, op11_substring_dedup, op12_spelling, op13_prefix_trie)}
