"""Relations that are kept up to date in buckets: an upsert rewrites the buckets that it touches, and one commit covers all relations.

    store/<relation>/v=<version>/bucket=<b>/part-*.parquet   what one commit wrote of a relation
    store/_manifests/<version>.json                          for each relation and bucket, the version that holds it
    store/_commits/<number>                                  names the manifest that is valid

A row's bucket is the hash of its key modulo the relation's number of buckets. A merge reads only the buckets in which keys of the
batch lie, brings old and new rows of a bucket together in one shuffle, and writes them anew beside the old ones. What a crashed
merge left is named by no manifest and is deleted by a later commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .state import POSTING_DATA, first_wins, latest, posting_id


@dataclass(frozen=True)
class Relation:
    """A relation's key and schema (without the bucket). buckets: some 128 MB each at the size that is expected; fixed for good."""

    key: Sequence[str]
    schema: str
    buckets: int = 64


#: Old rows of the touched buckets and new rows, both with their bucket, to the rows of these buckets.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class ConcurrentCommit(RuntimeError):
    """Another writer committed meanwhile; nothing of this merge is visible, and it can be run again."""


class Store:
    def __init__(self, spark: SparkSession, path: str, relations: dict[str, Relation]):
        self.spark, self.path, self.relations = spark, path.rstrip("/"), relations
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- files -------------------------------------------------------------------------------------------------

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[str]:
        at = self._at(path)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> None:
        """A file that must not be there yet."""
        stream = self._fs.create(self._at(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _commits(self) -> list[tuple[int, str]]:
        """Valid commits, the oldest first. A commit whose writer died before it named its manifest is none."""
        found = [(int(name), self._read(f"{self.path}/_commits/{name}")) for name in self._names(f"{self.path}/_commits") if name.isdigit()]
        return [c for c in found if c[1]]

    def _manifest(self, version: str | None) -> dict:
        return json.loads(self._read(f"{self.path}/_manifests/{version}.json")) if version else {"relations": {}, "batches": {}}

    # -- reading -----------------------------------------------------------------------------------------------

    def manifest(self) -> dict:
        commits = self._commits()
        return self._manifest(commits[-1][1] if commits else None)

    def _buckets(self, name: str, held: dict[str, str], only: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromDDL(self.relations[name].schema)
        paths = [f"{self.path}/{name}/v={held[b]}/bucket={b}" for b in (held if only is None else map(str, only)) if b in held]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("bucket", F.lit(None).cast("int"))
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)
        return read.withColumn("bucket", F.col("bucket").cast("int")).drop("v")

    def read(self, name: str) -> DataFrame:
        """The relation as the last commit left it; empty before the first one."""
        return self._buckets(name, self.manifest()["relations"].get(name, {})).drop("bucket")

    # -- writing -----------------------------------------------------------------------------------------------

    def bucket(self, name: str) -> Column:
        relation = self.relations[name]
        return F.pmod(F.xxhash64(*relation.key), F.lit(relation.buckets)).cast("int")

    def merge(self, changes: dict[str, tuple[DataFrame, Merge]], stream: str = "", batch: int | None = None, keep: int = 2) -> dict[str, int]:
        """Merges each relation's batch and commits all of them at once; gives the number of buckets rewritten, by relation.

        stream, batch: a batch of that number, or a later one, of that stream is committed once only; a repeated call does nothing.
        The last `keep` commits stay readable. Raises ConcurrentCommit if another writer was faster. A batch is read twice: for its
        buckets and for its rows.
        """
        commits = self._commits()
        before = self._manifest(commits[-1][1] if commits else None)
        if batch is not None and before["batches"].get(stream, -1) >= batch:
            return dict.fromkeys(changes, 0)
        number = int((self._names(f"{self.path}/_commits") or ["0"])[-1]) + 1
        version = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        relations = {name: dict(held) for name, held in before["relations"].items()}
        done = {}
        for name, (incoming, merge) in changes.items():
            new = incoming.withColumn("bucket", self.bucket(name))
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
            done[name] = len(touched)
            if not touched:
                continue
            held = relations.setdefault(name, {})
            rows = merge(self._buckets(name, held, touched), new)
            columns = StructType.fromDDL(self.relations[name].schema).names
            folder = f"{self.path}/{name}/v={version}"
            rows.select(*columns, "bucket").write.partitionBy("bucket").parquet(folder)
            written = {x.removeprefix("bucket=") for x in self._names(folder) if x.startswith("bucket=")}
            for b in map(str, touched):
                held.pop(b, None)
                if b in written:
                    held[b] = version
        batches = before["batches"] | ({stream: batch} if batch is not None else {})
        self._create(f"{self.path}/_manifests/{version}.json", json.dumps({"relations": relations, "batches": batches}))
        self._commit(number, version)
        self._clean(keep)
        return done

    def _commit(self, number: int, version: str) -> None:
        try:
            self._create(f"{self.path}/_commits/{number:012d}", version)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise ConcurrentCommit(f"commit {number} is there already") from e
            raise

    def _clean(self, keep: int) -> None:
        """Deletes what no commit that stays names: old commits and versions, and what crashed writers left before the oldest."""
        commits = self._commits()
        stay = commits[-keep:]
        used: dict[str, set[str]] = {}
        for _, version in stay:
            for name, held in self._manifest(version)["relations"].items():
                used.setdefault(name, set()).update(held.values())
        for number, version in commits[:-keep]:
            self._fs.delete(self._at(f"{self.path}/_commits/{number:012d}"), False)
            self._fs.delete(self._at(f"{self.path}/_manifests/{version}.json"), False)
        for name in self.relations:
            for folder in self._names(f"{self.path}/{name}"):
                version = folder.removeprefix("v=")
                # A version with a later number may belong to a writer at work.
                if version not in used.get(name, ()) and version[:12] <= f"{stay[-1][0]:012d}":
                    self._fs.delete(self._at(f"{self.path}/{name}/{folder}"), True)


def _together(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows of each bucket in one task; what groups by bucket and key afterwards needs no further shuffle."""
    spark = old.sparkSession
    rows = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket")


POSTINGS = Relation(("source", "url"), "id LONG, source STRING, url STRING, title STRING, company STRING, location STRING, raw_text STRING, scraped_at TIMESTAMP, first_seen TIMESTAMP, last_seen TIMESTAMP")
SEEN = Relation(("source", "external_id"), "source STRING, external_id STRING, accepted BOOLEAN, seen_at TIMESTAMP")


def merge_postings(now: Column, order: Sequence[str] = ("ordinal",)) -> Merge:
    """The last row of a (source, url) gives the data; id and first_seen of a known one stay."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        fresh = latest(new.select("bucket", "source", "url", *POSTING_DATA, *order), ["bucket", "source", "url"], order).drop(*order)
        fresh = fresh.withColumns({"scraped_at": now, "first_seen": now, "last_seen": now})
        data = F.max_by(F.struct(*POSTING_DATA, "scraped_at", "last_seen"), "_new").alias("d")
        rows = _together(old, fresh).groupBy("bucket", "source", "url").agg(F.max("id").alias("id"), F.min_by("first_seen", "_new").alias("first_seen"), data)
        return rows.select("bucket", "source", "url", F.coalesce("id", posting_id(F.col("source"), F.col("url"))).alias("id"), "first_seen", "d.*")

    return merge


def merge_seen(order: Sequence[str] = ("ordinal",)) -> Merge:
    """The first evaluation of a (source, external_id) wins for good."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        fresh = first_wins(new, ["bucket", "source", "external_id"], order).select("bucket", "source", "external_id", "accepted", "seen_at")
        rows = _together(old, fresh).groupBy("bucket", "source", "external_id").agg(F.min_by(F.struct("accepted", "seen_at"), "_new").alias("d"))
        return rows.select("bucket", "source", "external_id", "d.*")

    return merge
