"""SparkSession helpers.

The library never creates a session behind the caller's back; these helpers
are for tests, the bench and the command line.  Settings that matter at
scale (AQE, skew join, partition sizing) are set here once.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "rankwise") -> SparkSession:
    """Create (or reuse) a session configured for this engine."""
    master = master or os.environ.get("RANKWISE_MASTER", "local[8]")
    cpus = master[master.find("[") + 1:master.find("]")] if "[" in master else "8"
    parts = shuffle_partitions or (int(cpus) if cpus.isdigit() else 8)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RANKWISE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        # JSON answers may repeat a key; like a JSON parser, keep the last one
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is.  Only where it is unset on a single machine (tests) a scratch
    folder is created and registered; on a cluster that is an error, because
    executors could not read a folder of the driver's.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="rankwise-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def checkpointed(df):
    """Materialise ``df`` to the checkpoint folder and cut its lineage.

    Used for tables that feed many branches (ballots, consensus, parsed
    scores, ranking inputs): later branches read the written rows instead
    of recomputing the plan, and a lost executor does not force a
    recomputation from the base tables.  Reliable checkpoints only.  The
    frame is persisted while the checkpoint is written, because writing a
    reliable checkpoint otherwise evaluates the plan a second time.
    """
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist(blocking=False)
