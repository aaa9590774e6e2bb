"""Dense row positions and attaching frames by position (JON-4, SRC-8).

Positions 0..n-1 in the order of some columns, without a window over all rows:
rows are range-partitioned and sorted, written, and numbered inside their
partition; a second pass adds the rows of all partitions before. Only one count
per partition reaches the driver's plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, staging_path


def with_position(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """``df`` with a dense ``name`` by ``order`` (nulls first, ties by the
    sort's own order); the numbered rows are written before they are used."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = staging_path(spark, "positions")
    # The high bits of the id are the partition, the low ones the row in it.
    (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
     .withColumn("_id", F.monotonically_increasing_id()).write.parquet(path))
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_id", 33))
    counts = materialize(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")))  # a row per partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (rows.join(F.broadcast(before), "_part")
            .withColumn(name, F.col("_before") + F.col("_id") - F.shiftleft("_part", 33)).drop("_id", "_part", "_before"))


def attach(left: DataFrame, right: DataFrame, name: str = "position") -> DataFrame:
    """Rows of two frames with dense positions side by side. Frames of unequal
    length are an error, as nothing could be attached to the rest."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows on the left, {b} on the right")
    return left.join(right, name)
