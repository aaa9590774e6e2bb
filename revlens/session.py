"""Session helpers.

On a cluster the session comes from the launcher; these helpers only fill in
settings that are unset, so cluster configuration always wins.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Session defaults. They only fill in what the launcher (cluster config,
# spark-submit --conf) left unset.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches for pandas UDFs are cut by bytes as well as rows: reviews
    # can be long, and 10,000 long texts in one batch would sit in one Python
    # worker's memory at once.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.session.timeZone": "UTC",
}
# Spark's own defaults where they differ from ours.
_SPARK_DEFAULTS = {"spark.sql.execution.arrow.pyspark.enabled": "false"}
# Arrow batches of the text operators: a worker holds a batch several times over
# (bytes, strings, results), so rows and bytes are both cut.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20
# Settings that only take effect when this process launches Spark itself
# (local runs, tests); a cluster session keeps its own.
LAUNCH_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "revlens", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """The active session, or a new one. ``shuffle_partitions`` and ``extra``
    are explicit requests and always applied; ``DEFAULTS`` only where unset."""
    launching = SparkSession.getActiveSession() is None
    b = SparkSession.builder.appName(app)
    if launching:
        if master:
            b = b.master(master)
        for k, v in LAUNCH_DEFAULTS.items():
            b = b.config(k, v)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    context = _has_context(spark)
    launched = dict(spark.sparkContext.getConf().getAll()) if context else {}
    for k, v in DEFAULTS.items():
        if k in launched or k in (extra or {}):
            continue
        # A value that differs from Spark's own default was set at run time.
        if launching or not spark.conf.isModifiable(k) or spark.conf.get(k, None) in (None, _SPARK_DEFAULTS.get(k)):
            spark.conf.set(k, v)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if context:
        spark.sparkContext.setLogLevel("ERROR")
    return spark


def _has_context(spark: SparkSession) -> bool:
    """False on a Spark Connect session, which has no SparkContext / RDD API."""
    try:
        spark.sparkContext
    except Exception:  # noqa: BLE001 -- Connect raises its own not-supported error
        return False
    return True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Only a local master (tests, single-machine runs)
    may fall back to a private folder; on a cluster a machine-local folder
    would not be visible to other executors, so an unset setting is an error.
    On a Spark Connect session the server owns the folder; its setting is
    returned as is."""
    if not _has_context(spark):
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder shared by all executors")
        return d
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder shared by all executors")
        d = tempfile.mkdtemp(prefix="revlens-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def bound_batches(spark: SparkSession) -> None:
    """Cut the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes,
    so that a Python worker holds as much whatever a task reads (never raising a
    smaller setting)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(-?\d+)b?", str(spark.conf.get(key)))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def materialize(df):
    """Compute ``df`` once and cut its lineage: a reliable checkpoint written
    to the shared ``spark.checkpoint.dir`` (survives lost executors; never a
    local checkpoint). Meant for small intermediate results that later steps
    read more than once or size-check before choosing a join."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staging_path(spark: SparkSession, name: str) -> str:
    """A location for a written (lineage-cutting) table under the checkpoint folder."""
    base = checkpoint_dir(spark)
    return base.rstrip("/") + "/staging/" + name + "-" + os.urandom(6).hex()


def spread(df, key: str | None = None, min_partitions: int | None = None):
    """Give CPU-heavy per-row work enough tasks.

    A scan yields one task per file split; a small input (one parquet row
    group) would leave all text work on one core. Only when the scan has fewer
    partitions than the cluster's parallelism, hash-partition by ``key``
    (deterministic on task retry, no sort needed). Large inputs are already
    split into many tasks and pass through untouched -- no shuffle."""
    spark = df.sparkSession
    if not _has_context(spark):
        return df  # Spark Connect: no partition count to inspect; the scan's splits stand
    target = min_partitions or 2 * spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)
