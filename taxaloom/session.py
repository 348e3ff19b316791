"""Session settings for the jobs of this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan joins, merge small partitions and split skewed ones from measured sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Adaptive execution merges partitions but does not split them for size: start with many.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "taxaloom", **extra: str) -> SparkSession:
    """A session with adaptive execution on. On a cluster, master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    settings = {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(cores),
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    return session(**settings)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local session without the
    setting falls back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "taxaloom")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
