"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that is unset and driver and tasks are one process (tests), one of our own:
    on a cluster, executors would write to disks that nobody else sees."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="jobweave-")
        context.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        _delete(spark, path)


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/jobweave/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete_at_exit, spark, path)
    return path


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings that hold inside the block only. Names have _ for the dots."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_table(df: DataFrame, path: str, rows: int = 2000, mb: int = 16) -> None:
    """Writes df as Parquet. An Arrow batch to a Python worker is bounded in rows and bytes, so that long texts fit; the shuffle
    files of the job go as soon as the table stands. Nothing is broadcast but where a caller has checked its size and says so: an
    executor keeps a memory page of some 32 MB for each broadcast table, however small, until the driver happens to collect."""
    with settings(df.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch=str(rows), spark_sql_execution_arrow_maxBytesPerBatch=str(mb << 20), spark_sql_classic_shuffleDependency_fileCleanup_enabled="true", spark_sql_autoBroadcastJoinThreshold="-1"):
        df.write.parquet(path)


def materialize(df: DataFrame, tag: str, rows: int = 2000, mb: int = 16) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there, and a lost
    executor costs only the tasks that it ran."""
    path = new_path(df.sparkSession, tag)
    write_table(df, path, rows, mb)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._jw_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes the files of materialized tables that nothing reads any longer."""
    for df in tables:
        if df is not None:
            _delete(df.sparkSession, df._jw_path)


#: How to empty the caches that an operator keeps in a Python worker, by operator.
worker_caches: dict[str, Callable[[], None]] = {}


def begin(operator: str) -> None:
    """Called in a Python worker as a task begins: a worker serves several operators in turn, and the caches that others left,
    and memory that the allocators hold back, go."""
    for name, clear in worker_caches.items():
        if name != operator:
            clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else (lower() would fold other letters too)."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def attach_groups(rows: DataFrame, keys: Sequence[str], partial: Sequence[Column], final: Sequence[Column], salt: Column, having: Column | None = None, salts: int = 64) -> DataFrame:
    """Left-joins each row with the aggregates of its key's group, safely for a group of any size.

    Rows are pre-aggregated by (key, salt), those partial rows by key; the totals go back only to the (key, salt)
    pairs that exist, so one hot key is spread over up to `salts` tasks and no group is expanded beyond its
    own partial rows. Keys must not be null. having: keeps only those totals (others give nulls).
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    totals = salted.groupBy(*keys, "_salt").agg(*partial).groupBy(*keys).agg(*final, F.collect_set("_salt").alias("_salts"))
    if having is not None:
        totals = totals.where(having)
    return salted.join(totals.withColumn("_salt", F.explode("_salts")).drop("_salts"), [*keys, "_salt"], "left").drop("_salt")


def attach_by_key(rows: DataFrame, facts: DataFrame, key: str, salt: Column, salts: int = 64) -> DataFrame:
    """Left-joins rows with facts (at most one row a key), safely where one key holds many rows: a fact goes to each of the
    (key, salt) pairs that rows have, and nowhere else. Null keys match nothing."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    pairs = salted.where(F.col(key).isNotNull()).select(key, "_salt").distinct().groupBy(key).agg(F.collect_set("_salt").alias("_salts"))
    spread = facts.join(pairs, key).withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(spread, [key, "_salt"], "left").drop("_salt")
