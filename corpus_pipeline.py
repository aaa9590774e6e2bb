"""The corpus pipeline: from raw documents to packed training sequences.

Five stages, each one operator of ``revlens.llm`` applied to everything its
predecessor kept: quality classifier, toxicity, exact dedup, MinHash
near-dedup, best-fit packing. A stage reads a written table and returns a
DataFrame; ``run`` writes each stage's result under the shared
``spark.checkpoint.dir`` and reads it back, so a lost executor repeats work of
its own stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import exact_dedup, hyperminhash, packing, quality, toxicity
from revlens.llm.common import load, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs, load(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_rejected(docs, load(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hyperminhash.drop_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return (packing.pack(docs)
            .select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("best-fit packing", packing_stage),
]

# Learned scores and tokenisation have no SQL form; tests/llm holds a
# brute-force version of the deterministic stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
