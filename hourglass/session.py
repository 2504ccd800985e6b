"""SparkSession helpers.

On a cluster the session is created by the platform; the library only reads
settings from it.  ``local_session`` is for tests and the bench: it builds a
local session and sets a checkpoint folder only when the session has none.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, partitions: int | None = None,
                  app: str = "hourglass", extra_conf: dict[str, str] | None = None) -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    partitions = partitions or cpus
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is used as is.  Only a local
    session (one JVM, one disk) without the setting gets a scratch folder;
    on a cluster a missing setting is an error, as executors do not share disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="hourglass-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def materialise(df):
    """Compute ``df`` once for several later reads: a reliable checkpoint in the
    shared folder, which survives executor loss and cuts the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


cut_lineage = materialise


def cluster_settings(total_bytes: float = 100e12, executors: int = 1000, cores_per_executor: int = 8,
                     target_partition_bytes: float = 256e6) -> dict[str, str]:
    """Suggested SQL settings for a large cluster (not applied automatically).

    Scan splits and post-shuffle partitions are sized to ~256 MB so a task's
    working set fits executor memory; the initial shuffle width is generous
    (enough partitions for the whole input at that size) and AQE coalesces it
    down per stage and splits skewed join partitions at runtime.
    """
    initial = max(int(total_bytes / target_partition_bytes), executors * cores_per_executor * 2)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(int(target_partition_bytes)),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.shuffle.partitions": str(min(initial, 200_000)),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(int(target_partition_bytes * 4)),
        "spark.sql.files.maxPartitionBytes": str(int(target_partition_bytes)),
        # broadcast only sides measured below 64 MB at runtime
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.session.timeZone": "UTC",
    }
