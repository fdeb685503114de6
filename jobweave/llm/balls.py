"""Ball k-means: exact clustering with integer centroids.

A cluster is a ball: its centroid and the distance of its farthest member. Another centroid is a neighbour of a ball if half the way
to it lies within the radius; no member can be nearer to any other. Neighbours, sorted by distance, cut the ball into a
stable core, whose members stay unseen, and annuli; members of the n-th annulus are compared with the n nearest neighbours only.

Vectors lie in blocks, bucketed by block, and never move again: each round reads them beside the assignment of the round before,
bucketed alike. The part of a cluster in a block is a ball of its own, with its own, smaller, radius. A round returns one row of sums a task.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _delete, begin, materialize, new_path, settings
from .vectors import integers

BLOCK = 2048  # vectors a block
BLOCKS = 256  # blocks a bucket, about


def _limit(dims: int) -> int:
    """Up to there, four times a squared distance fits into 64 bits."""
    return 1 << ((58 - (dims - 1).bit_length()) // 2)


def _blocks(rows: DataFrame, scale: int, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op11")
        ids, held, number = [], [], TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            x = np.concatenate(held).astype("<i4")
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([[i for part in ids for i in part]], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=["block", "vec_ids", "vectors"])

        for batch in batches:
            at, x = integers(batch.column("embedding"), scale, dims, _limit(dims))
            found = batch.column("vec_id").take(pa.array(at)).to_pylist()
            for k in range(0, len(at), BLOCK):
                ids.append(found[k : k + BLOCK])
                held.append(x[k : k + BLOCK])
                if sum(map(len, held)) >= BLOCK:
                    yield block()
                    ids, held, number = [], [], number + 1
        if held:
            yield block()

    return rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "block long, vec_ids array<bigint>, vectors binary")


def _seeds(rows: DataFrame, scale: int, dims: int, k: int, seed: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op11")
        for batch in batches:
            at, x = integers(batch.column("embedding"), scale, dims, _limit(dims))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(list(x), pa.list_(pa.int64()))], names=["vec_id", "x"])

    kept = rows.select(F.col("vec_id").cast("long"), "embedding").where("vec_id IS NOT NULL").mapInArrow(run, "vec_id long, x array<bigint>")
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "x").limit(k).collect()  # k rows
    return np.array([r.x for r in first], np.int64).reshape(-1, dims)


class _Bucketed:
    """A table in the shared folder, bucketed by block; gone after drop()."""

    def __init__(self, df: DataFrame, n: int):
        self.spark, self.name, self.path = df.sparkSession, f"jobweave_{uuid.uuid4().hex}", new_path(df.sparkSession, "balls")
        with settings(self.spark, spark_sql_execution_arrow_maxRecordsPerBatch="64", spark_sql_autoBroadcastJoinThreshold="-1", spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
            df.write.option("path", self.path).bucketBy(n, "block").saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        _delete(self.spark, self.path)


def _distances(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    x = x - center
    return np.einsum("nd,nd->n", x, x)


def assign(x: np.ndarray, own: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (the smaller number of equals) and the squared distance to it. own: where the
    vectors were before; the result doesn't depend on it."""
    nearest, best = own.copy(), np.zeros(len(x), np.int64)
    for i in np.unique(own):
        members = np.flatnonzero(own == i)
        d = _distances(x[members], centers[i])
        apart = _distances(centers, centers[i])
        apart[i] = np.iinfo(np.int64).max
        order = np.argsort(apart, kind="stable")
        order = order[apart[order] <= 4 * d.max()]  # half the way lies within the radius
        # How many neighbours may be as near as the own centroid: none in the core, n in the n-th annulus.
        annulus = np.searchsorted(apart[order], 4 * d, side="right")
        who = np.full(len(members), i)
        for s, j in enumerate(order):
            some = np.flatnonzero(annulus > s)
            other = _distances(x[members[some]], centers[j])
            nearer = (other < d[some]) | ((other == d[some]) & (j < who[some]))
            d[some[nearer]], who[some[nearer]] = other[nearer], j
        nearest[members], best[members] = who, d
    return nearest, best


def _assigned(blocks: DataFrame, before: DataFrame | None, centers: np.ndarray, final: bool) -> DataFrame:
    """Each block's assignment, and in one row a task sums and counts of the clusters; or, at last, a row a vector."""
    k, dims = centers.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        begin("op11")
        for batch in batches:
            for block, ids, vectors, own in zip(*batch.columns, strict=True):
                x = np.frombuffer(vectors.as_py(), "<i4").reshape(-1, dims).astype(np.int64)
                was = np.frombuffer(own.as_py(), "<i4").astype(np.int64) if own.is_valid else np.zeros(len(x), np.int64)
                yield block.as_py(), ids, x, *assign(x, was, centers)

    def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, waiting = np.zeros((k, dims + 1), np.int64), None

        def row(last: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([waiting[0]]), pa.array([waiting[1].astype("<i4").tobytes()], pa.binary()), pa.array([totals.ravel().tolist() if last else None], pa.list_(pa.int64()))], names=["block", "own", "totals"])

        for number, _, x, own, _ in work(batches):
            if waiting:
                yield row(False)
            waiting = number, own
            order = np.argsort(own, kind="stable")
            found, at = np.unique(own[order], return_index=True)
            totals[found, :dims] += np.add.reduceat(x[order], at)
            totals[found, dims] += np.diff(np.append(at, len(own)))
        if waiting:
            yield row(True)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, _, own, distance in work(batches):
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(own.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    joined = blocks.withColumn("own", F.lit(None).cast("binary")) if before is None else blocks.join(before.select("block", "own").hint("shuffle_hash"), "block", "left")
    joined = joined.select("block", "vec_ids", "vectors", "own")
    if final:
        return joined.mapInArrow(results, "vec_id long, cluster int, distance long")
    return joined.mapInArrow(rounds, "block long, own binary, totals array<bigint>")


def ball_kmeans(rows: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: int = 3) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    Kept are the vectors (column embedding) with exactly `dims` components, none null, non-finite or so large that distances leave
    64 bits (|floor(scale * x)| over 2^26 with 64 components); components become floor(scale * x). Centroids start as the k vectors with the
    least sha256 of "seed:vec_id"; of fewer vectors than k, each starts a cluster. Each round assigns all vectors to the nearest
    centroid (of equals, the smaller number) and moves each centroid that has vectors to floor(sum / count); at last they are assigned
    once more. A row that repeats counts as often as it stands; of a vec_id that repeats with other vectors, the least vector
    starts first. Rows without a vec_id are clustered but start none. Without vectors the result is empty. Other columns are not read.
    The driver holds the centroids, k * dims numbers; nothing else that leaves the tasks grows with more than their number.
    """
    spark = rows.sparkSession
    centers = _seeds(rows, scale, dims, k, seed)
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centers):
        return spark.createDataFrame([], empty)
    packed = materialize(_blocks(rows, scale, dims), "balls-blocks")
    count = packed.count()
    n = min(count, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(count / BLOCKS)))
    blocks, before = _Bucketed(packed.repartition(n, "block"), n), None
    for _ in range(rounds):
        now = _Bucketed(_assigned(blocks.df, before and before.df, centers, False), n)
        if before:
            before.drop()
        before = now
        found = now.df.where("totals IS NOT NULL").select(F.posexplode("totals")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("sum")).collect()  # k * (dims + 1) rows
        totals = np.zeros(centers.shape[0] * (dims + 1), object)
        for r in found:
            totals[r.pos] = int(r["sum"])
        totals = totals.reshape(-1, dims + 1)
        centers = np.array([[s // t[-1] for s in t[:-1]] if t[-1] else c.tolist() for t, c in zip(totals, centers, strict=True)], np.int64)
    out = materialize(_assigned(blocks.df, before and before.df, centers, True), "balls")
    blocks.drop()
    if before:
        before.drop()
    of = out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # k rows
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centers]
    facts = spark.createDataFrame([(r.cluster, r.s, sum(q.s for q in of), digest[r.cluster]) for r in of], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # facts: k rows


def oracle(k: int = 8, rounds: int = 10) -> str:
    """The query in SQL: every round compares all vectors with all centroids."""
    out = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS cluster, x AS c FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        out.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM v, c{r} "
            "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"
        )
        if r < rounds:
            sums = f"SELECT cluster, i, floor(sum(y)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT cluster, unnest(x) AS y, unnest(range(64)) AS i FROM a{r}) GROUP BY cluster, i"
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT cluster, list(m ORDER BY i) AS c FROM ({sums}) GROUP BY cluster) m USING (cluster))")
    last = f"SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"
    return f"WITH {', '.join(out)} {last}"
