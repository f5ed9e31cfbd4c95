"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

HOT_ROWS_CONF = "spark.sliceweave.hotRows"
BROADCAST_ROWS_CONF = "spark.sliceweave.broadcastRows"


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sliceweave")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def hot_rows(spark: SparkSession) -> int:
    """Largest group one window task may hold before it is split."""
    return int(spark.conf.get(HOT_ROWS_CONF, "2000000"))


def broadcast_rows(spark: SparkSession) -> int:
    """Largest counted row number that may be broadcast."""
    return int(spark.conf.get(BROADCAST_ROWS_CONF, "1000000"))


def shared_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the cluster; a private one only for local masters."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="sliceweave-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
