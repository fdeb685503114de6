"""Session helper: defaults for local runs; a cluster keeps its own settings."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", app: str = "jobweave") -> SparkSession:
    """A local session with a small shuffle; getOrCreate, so a running one is reused."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own: dict[str, str] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir, deleted when the driver ends. Only where that is unset and driver and
    tasks are one process (tests), in a folder of our own: on a cluster, nobody else would see it."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="jobweave-"))
    path = f"{base.rstrip('/')}/jobweave/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session that holds inside the block only."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
