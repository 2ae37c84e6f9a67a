"""Spark session and lineage helpers.

The library never assumes a machine-local folder: the checkpoint folder is
whatever the cluster names in ``spark.checkpoint.dir``.  Only in local mode
(tests, a laptop) do we create one ourselves where that is unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ratebook", cpus: int | str = "*",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE on, the UI off and UTC time (oracle comparisons)."""
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus) * 2, 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go with their tables
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
    scratch = tempfile.mkdtemp(prefix="ratebook-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    return scratch


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition to the cluster's parallelism before an iterative loop.

    An upstream plan may end in very few partitions (AQE coalesces small
    shuffles); every round of a fit re-reads the table, so it must be spread
    over all cores once.  An explicit partition count is not coalesced.
    """
    # two tasks per core: every round then keeps all cores busy
    n = max(2, 2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys) if keys else df.repartition(n)
