"""Counter tables kept by micro-batches: a base snapshot and the deltas after it.

Every micro-batch writes its rows under ``table/epoch=<n>`` (rewritten when the
batch is repeated). After ``every`` deltas they are merged with the base into
``table/_base/upto=<n>``; a base counts once Spark's committer has put its
``_SUCCESS`` file there, so a reader never sees half of one. Epochs up to the
newest base are not read any more, and what the base before it replaced is
deleted, so the number of files read stays bounded however long the stream runs.
A repeated batch rewrites its own delta: below the base it is ignored, above it it
counts once.

Folders are listed through Hadoop's file system classes, so any store works.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = 20
_SUCCESS = "_SUCCESS"


def _complete(spark: SparkSession, folder: str, prefix: str) -> dict[int, str]:
    """Number -> path of the committed ``prefix<number>`` folders."""
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return {int(x[len(prefix):]): f"{folder}/{x}" for x in names
            if x.startswith(prefix) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}/{_SUCCESS}"))}


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession, table: str) -> tuple[int | None, str | None, dict[int, str]]:
    """(newest base's epoch, its path, the deltas after it)."""
    bases = _complete(spark, f"{table}/_base", "upto=")
    top = max(bases, default=None)
    deltas = {n: p for n, p in _complete(spark, table, "epoch=").items() if top is None or n > top}
    return top, bases.get(top), deltas


def read(spark: SparkSession, table: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table as of the newest micro-batch: base and deltas, merged.
    ``merge`` gets rows with their ``epoch`` and returns rows with an ``epoch``."""
    _, base, deltas = parts(spark, table)
    frames = [spark.read.parquet(base)] if base else []
    frames += [spark.read.parquet(p).withColumn("epoch", F.lit(n).cast("long")) for n, p in sorted(deltas.items())]
    if not frames:
        raise ValueError(f"no committed micro-batch under {table}")
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    return merge(rows)


def publish(df: DataFrame, table: str, epoch: int, merge: Callable[[DataFrame], DataFrame], every: int = EVERY) -> None:
    """Write a micro-batch's rows and compact when due."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")
    top, _, deltas = parts(spark, table)
    if len(deltas) < every:
        return
    last = max(deltas)
    read(spark, table, merge).write.mode("overwrite").parquet(f"{table}/_base/upto={last}")
    # Readers may still be on the base before: it and its deltas stay until the next one.
    for n, p in _complete(spark, f"{table}/_base", "upto=").items():
        if top is not None and n < top:
            _delete(spark, p)
    for n, p in _complete(spark, table, "epoch=").items():
        if top is not None and n <= top:
            _delete(spark, p)


def newest_wins(keys: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    """Merge of totals: the row of a key's newest epoch."""
    def merge(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_v"))
        return newest.select(*keys, *[F.col("_v")[c].alias(c) for c in values])
    return merge


def sums(keys: tuple[str, ...], values: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    """Merge of additive counters."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values], F.max("epoch").alias("epoch"))
    return merge
