"""Result files in one order over all files (SNK-2, TXT-7).

Rows are range-partitioned by their order and sorted, so that the files in the order
of their writing tasks and of each task's files, read one after another, hold all rows
in order. Rows that agree on the order
are told apart by a hash of their columns, so a hot value is split over files. The
manifest (``<path>/_manifest``) has a row per file: its number of rows and the place
of its first one. It is counted from the files that were written and comes last: a
folder without one is not complete, whatever a failed job left in it.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches, staging_path
from .reviews import write_results_csv

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MANIFEST = "_manifest"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_ordered_csv(df: DataFrame, path: str, order: list[str], columns: list[str], parts: int | None = None,
                      expand: Callable[[DataFrame], DataFrame] | None = None, compression: str = "gzip") -> DataFrame:
    """Write ``columns`` in the order of ``order`` and return the manifest. The rows
    are staged first: finding the ranges reads them once more. ``expand`` (narrow
    steps only) makes the written rows of each sorted row, after the exchange, so
    that what it repeats is neither staged nor exchanged. Files are compressed, since
    the rows of one text repeat it (``compression="none"``: plain text); a file with
    line ends in its cells is read by one task either way."""
    spark = df.sparkSession
    staged = staging_path(spark, "export")
    keep = dict.fromkeys([*order, *(df.columns if expand else columns)])
    df.select(*[f"`{c}`" for c in keep]).write.parquet(staged)
    rows = spark.read.parquet(staged)
    by = [F.col(f"`{c}`") for c in order] + [F.xxhash64(*[F.col(f"`{c}`") for c in keep])]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    write_results_csv((expand(rows) if expand else rows).select(*[f"`{c}`" for c in columns]), path, compression)
    counts = _files(spark, path).select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))
    # A row per file; the writing task, then the number of its file: their digits
    # may grow, so that names alone do not keep the order.
    place = [F.regexp_extract("file", of, 1).cast("int") for of in (r"^part-(\d+)-", r"-c(\d+)\.csv")]
    first = counts.withColumn("first_row", F.sum("n_rows").over(Window.orderBy(*place)) - F.col("n_rows"))
    first.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    return spark.read.parquet(f"{path}/{MANIFEST}")


def read_ordered_csv(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """The rows with their dense place in the order. A file is read by one task
    from its start, so its rows are numbered as they pass, without an exchange; the
    manifest adds the files before. A folder without manifest is an error."""
    bound_batches(spark)
    manifest = spark.read.parquet(f"{path}/{MANIFEST}").select("file", "first_row")
    rows = _files(spark, path).select("*", F.col("_metadata.file_name").alias("_file"))
    numbered = rows.mapInArrow(_number, T.StructType([*rows.schema.fields, T.StructField("_nth", T.LongType())]))
    return (numbered.join(manifest, F.col("_file") == F.col("file")).withColumn(name, F.col("first_row") + F.col("_nth"))
            .drop("_file", "_nth", "file", "first_row"))


def _number(batches):
    """Adds each row's place in its file; the last column names the file."""
    seen: dict[str, int] = {}
    for batch in batches:
        nth = []
        for file in batch.column(batch.num_columns - 1).to_pylist():
            seen[file] = seen.get(file, -1) + 1
            nth.append(seen[file])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], [*batch.schema.names, "_nth"])
