"""Spark session helpers.

The library never creates a session behind the caller's back: every operator
takes DataFrames.  ``get_session`` is a convenience for tests, the bench and
local runs; on a cluster the caller's session (and its configuration) wins.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every operator assumes.  ANSI stays on (Spark 4 default): the
# operators use try_cast / try_divide / try_to_timestamp where input may be bad.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tabsmith", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` is only applied when given (tests pass ``local[N]``); a cluster
    submit supplies its own.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = "8g"  # local mode: the driver JVM is the executor
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    active = SparkSession.getActiveSession()
    if master and master.startswith("local") and (
            active is None or not active.sparkContext.getConf().get("spark.checkpoint.dir", None)):
        conf.setdefault("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tabsmith-ckpt-"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared folder and is respected as is.
    Only when it is unset (local tests) a fresh scratch folder is created.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tabsmith-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


FILE_ROWS = 100_000  # rows aimed at in a file of a stored table whose size is known


def cut_lineage(df, rows: int | None = None):
    """Cut the lineage by writing the frame as a Parquet table under the shared
    checkpoint folder and reading it back.

    ``rows``: about how many rows the last stage of ``df`` reads and makes at
    most, where the caller knows it.  A small table is then not spread over as
    many files as there are shuffle partitions, but over one for each
    ``FILE_ROWS`` rows (as many as the cluster has cores at least).

    One write job (``Dataset.checkpoint`` would run the plan a second time to
    save the RDD unless it is cached); the stored table survives executor loss
    and later jobs read it with column pruning and filter pushdown."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"cut-{uuid.uuid4().hex}")
    if rows is not None:
        df = df.coalesce(files_for(spark, rows))
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def files_for(spark: SparkSession, rows: int) -> int:
    """Files (and tasks) for a stored table of ``rows`` rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)
