"""Session helpers: a local session for tests/bench and the checkpoint folder rule.

On a cluster the session is created by the platform; this module only reads its settings.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "vendorlens") -> SparkSession:
    """A local[N] session with AQE on and the UI off (tests, bench, smoke runs)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("VENDORLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used as is. Only a
    local-mode session without that setting (tests, laptops) gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="vendorlens-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


FILE_BYTES_PER_TASK = 16 << 20  # Parquet or compressed text, about a million rows of a fact


def stored_bytes(spark: SparkSession, path: str) -> int:
    """The length of the files at ``path``; 0 where there is nothing. The file system is asked, nothing is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def tasks_for(spark: SparkSession, amount: int, per_task: int) -> int:
    """Tasks of a shuffle that moves ``amount`` bytes or rows: the session's number, or more where a task would get
    over ``per_task``, so that the memory of a task does not grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // per_task))


def materialize(df):
    """Write ``df`` to the reliable checkpoint folder and read it back: later scalar subqueries and
    joins reuse the stored rows instead of recomputing the lineage, and a lost executor cannot force
    a recomputation from the raw tables.

    The rows are persisted for the duration of the checkpoint: writing the checkpoint files is a
    second job over the same RDD, which would otherwise recompute the whole plan."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    staged = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = staged.checkpoint(eager=True)
    staged.unpersist()
    return out
