"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the jobs rely on; a cluster's own values win over them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Tables of keys up to this size prune a large fact's scan by a Bloom filter; the filter itself has a fixed size.
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB",
}


def local_session(cpus: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """Session for tests and measurements on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bomdrift")
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """Shared folder for written tables, as spark.checkpoint.dir names it.

    Where that is unset, a local session gets a temporary folder; a cluster is refused, because its
    executors share no local disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
