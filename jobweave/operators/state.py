"""Incremental state: upserts, seen marks, labels and pending work, as set operations on whole relations.

Parquet has no MERGE, so an upsert gives the new relation, which `publish` writes beside the old one and then names as current.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POSTING_DATA = ("title", "company", "location", "raw_text")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by the order columns (pre-aggregated, no sort of a whole key)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def posting_id(source: Column, url: Column) -> Column:
    """An identifier that needs no counter and is the same in every run."""
    return F.xxhash64(source, url)


def upsert_postings(target: DataFrame, incoming: DataFrame, now: Column, order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """target after the incoming rows: the last row of a (source, url) gives the data; id and first_seen of a known one stay."""
    new = latest(incoming, ["source", "url"], order).select("source", "url", *(F.col(c).alias(f"n_{c}") for c in POSTING_DATA), F.lit(True).alias("fresh"))
    both = target.join(new, ["source", "url"], "full_outer")
    fresh = F.coalesce("fresh", F.lit(False))
    return both.select(
        F.coalesce("id", posting_id(F.col("source"), F.col("url"))).alias("id"),
        "source",
        "url",
        *(F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in POSTING_DATA),
        *(F.when(fresh, now).otherwise(F.col(c)).alias(c) for c in ("scraped_at",)),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(fresh, now).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def upsert_by_key(target: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Whole rows replaced by key; the last incoming row of a key counts."""
    new = latest(incoming, [key], order).select(*target.columns)
    return target.join(new, key, "left_anti").unionByName(new)


def mark_seen(seen: DataFrame, incoming: DataFrame, order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """seen with the keys that are new; the first evaluation of a key wins."""
    new = first_wins(incoming, ["source", "external_id"], order).join(seen, ["source", "external_id"], "left_anti")
    return seen.unionByName(new.select(*seen.columns))


def insert_labels(labels: DataFrame, incoming: DataFrame) -> DataFrame:
    """labels with incoming rows; a label other than 0, 1, 2, or one for a labelled id, fails the job."""
    known = labels.select("vacancy_id", F.lit(True).alias("_known"))
    checked = incoming.withColumn("_n", F.count("*").over(Window.partitionBy("vacancy_id"))).join(known, "vacancy_id", "left")
    bad = F.col("_known").isNotNull() | (F.col("_n") > 1) | ~F.coalesce(F.col("label").isin(0, 1, 2), F.lit(False))
    label = F.when(bad, F.raise_error(F.concat(F.lit("bad or repeated label for "), F.col("vacancy_id").cast("string"))).cast("int")).otherwise(F.col("label"))
    return labels.unionByName(checked.withColumn("label", label).select(*labels.columns))


def delete_labels(labels: DataFrame, undone: DataFrame) -> DataFrame:
    return labels.join(undone, "vacancy_id", "left_anti")


def unseen(listing: DataFrame, seen: DataFrame) -> DataFrame:
    return listing.join(seen, ["source", "external_id"], "left_anti")


def pending_extraction(vacancies: DataFrame, extractions: DataFrame) -> DataFrame:
    """id and raw_text of postings with a text and without an extraction."""
    open_ = vacancies.where("raw_text IS NOT NULL AND raw_text <> ''").select("id", "raw_text")
    return open_.join(extractions.select(F.col("vacancy_id").alias("id")), "id", "left_anti")


def pending_labels(vacancies: DataFrame, extractions: DataFrame, labels: DataFrame) -> DataFrame:
    open_ = vacancies.withColumnRenamed("id", "vacancy_id").join(labels, "vacancy_id", "left_anti")
    return open_.join(extractions, "vacancy_id")


def labeled(labels: DataFrame, vacancies: DataFrame, extractions: DataFrame) -> DataFrame:
    return labels.join(vacancies.withColumnRenamed("id", "vacancy_id"), "vacancy_id").join(extractions, "vacancy_id")


def evolve(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the columns that it lacks, as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions that are complete, the oldest first."""
    fs, at = _files(spark, path)
    folder = at(f"{path}/_versions")
    return sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []


def read_published(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The relation that was published last; empty if there is none."""
    versions = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{versions[-1]}") if versions else spark.createDataFrame([], schema)


def publish(df: DataFrame, path: str, keep: int = 2) -> None:
    """Makes df the relation at path (see read_published). One writer at a time.

    The rows go to a folder of their own; then one empty file, whose name is the folder's, makes it current. Nothing is renamed or
    overwritten, so after a crash at any point the version before is there, whole; what a crashed run left is deleted by
    the next one that succeeds. The last `keep` versions stay, for readers that began before.
    """
    spark = df.sparkSession
    fs, at = _files(spark, path)
    before = _versions(spark, path)
    number = int(before[-1].split("-")[1]) + 1 if before else 1
    name = f"version-{number:012d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{name}")
    fs.create(at(f"{path}/_versions/{name}"), False).close()
    for old in before[: 1 - keep or None]:
        fs.delete(at(f"{path}/_versions/{old}"), False)
    kept = {name, *before[len(before) + 1 - keep :]}
    for x in fs.listStatus(at(path)):
        if x.getPath().getName().startswith("version-") and x.getPath().getName() not in kept:
            fs.delete(x.getPath(), True)
