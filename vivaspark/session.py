"""Session settings and table access."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(app: str = "vivaspark", cores: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and one shuffle partition a core in local mode.

    On a cluster the master, memory and partition counts come from its own settings.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    b = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ and "spark.master" not in conf:
        b = b.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", "8g")
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; Parquet readers prune columns and push filters down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary one serves a local session, whose tasks all
    run on this machine; on a cluster that is an error, since executors would
    write to their own disks.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="viva-")
    if known.isEmpty():
        sc.setCheckpointDir(folder)
    return folder
