"""Hard-negative mining by bit-sliced integer products.

Rows lie in blocks as bit-planes of their integer components (two's complement). A block of anchors meets a block of rows plane
after plane, the most significant first: the planes seen give a part of each product, those unseen can add no more than the
anchor's positive components and take no more than its negative ones. A candidate goes as soon as its interval can't qualify
any longer: for positives, beneath the best lower ends and the best scores of the task so far; for negatives, outside every positive's
range. What outlives the last plane has its exact product.

Anchors are met in slices of a bounded size, each broadcast in turn; a task keeps the best rows of each anchor and returns only those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, forget, materialize, new_path, settings, write_table
from .vectors import integers

BLOCK = 4096  # rows a block
ANCHORS = 512  # anchors a block
SLICE_BYTES = 8 << 20  # of anchors that are broadcast at a time
SPARSE = 16  # pairs are followed one by one when fewer than one in so many is left
PAIRS = 1 << 16  # such pairs at a time
_LEAST, _MOST = np.iinfo(np.int64).min // 4, np.iinfo(np.int64).max // 4


def _limit(dims: int) -> int:
    """Up to there, a hundred times a product fits into 64 bits."""
    return 1 << ((55 - max(dims - 1, 0).bit_length()) // 2)


def _each_size(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    column = batch.column("embedding")
    for dims in pc.unique(pc.list_value_length(column)).to_pylist():
        if dims is not None:
            at, x = integers(column, scale, dims, _limit(dims))
            if len(at):
                yield dims, at, x


def _planes(x: np.ndarray) -> tuple[int, bytes]:
    """Number of bits of the components, sign included, and their planes, packed, the most significant first."""
    bits = max(int(max(x.max(initial=0), -1 - x.min(initial=0))).bit_length(), 1) + 1
    return bits, b"".join(np.packbits((x >> b & 1).astype(np.uint8)).tobytes() for b in range(bits - 1, -1, -1))


def _row_blocks(rows: DataFrame, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op12")
        waiting: dict[int, list] = {}

        def block(dims: int) -> pa.RecordBatch:
            ids, labels, x = (np.concatenate(c) for c in zip(*waiting.pop(dims), strict=True))
            bits, planes = _planes(x)
            return pa.RecordBatch.from_arrays([pa.array([dims]), pa.array([bits]), *(pa.array([b], pa.binary()) for b in (ids.tobytes(), labels.tobytes(), planes))], names=["dims", "bits", "ids", "labels", "planes"])

        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for dims, at, x in _each_size(batch, scale):
                for k in range(0, len(at), BLOCK):
                    waiting.setdefault(dims, []).append((ids[at[k : k + BLOCK]], labels[at[k : k + BLOCK]], x[k : k + BLOCK]))
                    if sum(len(w[0]) for w in waiting[dims]) >= BLOCK:
                        yield block(dims)
        for dims in list(waiting):
            yield block(dims)

    return rows.mapInArrow(run, "dims long, bits long, ids binary, labels binary, planes binary")


def _anchor_blocks(anchors: DataFrame, scale: int) -> DataFrame:
    """Anchors, sorted by slice, in blocks (number ab; an anchor's place in it is pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op12")
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            slices = batch.column("slice").to_numpy()
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for dims, at, x in _each_size(batch, scale):
                for s in np.unique(slices[at]):
                    own = np.flatnonzero(slices[at] == s)
                    for k in range(0, len(own), ANCHORS):
                        some = own[k : k + ANCHORS]
                        yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([number]), pa.array([dims]), *(pa.array([b.tobytes()], pa.binary()) for b in (ids[at[some]], labels[at[some]], x[some]))], names=["slice", "ab", "dims", "anchor_ids", "anchor_labels", "anchors"])
                        number += 1

    return anchors.mapInArrow(run, "slice int, ab long, dims long, anchor_ids binary, anchor_labels binary, anchors binary")


class _Tops:
    """The best k of each slot: highest score, then least id."""

    def __init__(self, k: int):
        self.k, self.slot, self.score, self.ids = k, *(np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, slot)
        order = order[np.arange(len(slot)) - first < self.k]
        self.slot, self.score, self.ids = slot[np.arange(len(slot)) - first < self.k], score[order], ids[order]

    def least(self, slots: int) -> np.ndarray:
        """What a candidate must reach, by slot: the k-th score, if there are k."""
        out = np.full(slots, _LEAST)
        full = np.flatnonzero(np.bincount(self.slot, minlength=slots) == self.k)
        out[full] = self.score[np.searchsorted(self.slot, full, side="right") - 1]
        return out


def products(a: np.ndarray, planes: list[np.ndarray], open_: np.ndarray, low: np.ndarray, high: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of anchors and rows, and their products, that are open and lie within one of the anchor's ranges [low, high] (one
    column a range). k: only the k best of an anchor, and their equals, are needed. planes: 0 and 1, a matrix of rows each."""
    plus, minus = np.maximum(a, 0).sum(axis=1).astype(np.int64), np.minimum(a, 0).sum(axis=1).astype(np.int64)
    low = low.copy()
    seen, b = np.zeros(open_.shape, np.int64), len(planes)
    while b and np.count_nonzero(open_) * SPARSE > open_.size:
        b -= 1
        weight = -(1 << b) if b == len(planes) - 1 else 1 << b
        seen += weight * (a @ planes[len(planes) - 1 - b].T).astype(np.int64)
        rest = (1 << b) - 1
        if 0 < k <= open_.shape[1]:
            kth = np.partition(np.where(open_, seen, _LEAST), -k, axis=1)[:, -k]
            low[:, 0] = np.maximum(low[:, 0], np.where(kth == _LEAST, _LEAST, kth + rest * minus))
        open_ = open_ & (seen >= (low.min(axis=1) - rest * plus)[:, None]) & (seen <= (high.max(axis=1) - rest * minus)[:, None])
    at = np.flatnonzero(open_)
    out = []
    for start in range(0, len(at), PAIRS):
        i, j = np.divmod(at[start : start + PAIRS], open_.shape[1])
        s = seen[i, j]
        for c in range(min(b, len(planes) - 1), -1, -1):
            if c < b:
                weight = -(1 << c) if c == len(planes) - 1 else 1 << c
                s = s + weight * np.einsum("pd,pd->p", a[i], planes[len(planes) - 1 - c][j]).astype(np.int64)
            rest = (1 << c) - 1
            stay = ((s + rest * plus[i])[:, None] >= low[i]) & ((s + rest * minus[i])[:, None] <= high[i])
            stay = stay.any(axis=1)
            i, j, s = i[stay], j[stay], s[stay]
        out.append((i, j, s))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _scored(blocks: DataFrame, anchors: DataFrame, take: int, ranges: int = 0) -> DataFrame:
    """The best rows of each anchor (with ranges, so many an anchor: of each of them) that a task saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op12")
        tops: dict[int, _Tops] = {}
        known: dict[int, np.ndarray] = {}
        held, planes = None, []
        for batch in batches:
            rows = [batch.column(c) for c in batch.schema.names]
            for dims, bits, ids, labels, packed, ab, anchor_ids, anchor_labels, x, *given in zip(*rows, strict=True):
                dims, ab = dims.as_py(), ab.as_py()
                ids, labels, anchor_ids, anchor_labels = (np.frombuffer(c.as_py(), np.int64) for c in (ids, labels, anchor_ids, anchor_labels))
                packed = packed.as_py()
                if packed != held:
                    held, n, size = packed, len(ids) * dims, math.ceil(len(ids) * dims / 8)
                    planes = [np.unpackbits(np.frombuffer(packed, np.uint8, size, p * size), count=n).reshape(len(ids), dims).astype(np.float64) for p in range(bits.as_py())]
                a = np.frombuffer(x.as_py(), np.int64).reshape(-1, dims).astype(np.float64)
                top, known[ab] = tops.setdefault(ab, _Tops(take)), anchor_ids
                if not ranges:
                    least = top.least(len(a))[:, None]
                    for label in np.intersect1d(labels, anchor_labels):
                        i, j = np.flatnonzero(anchor_labels == label), np.flatnonzero(labels == label)
                        p, q, s = products(a[i], [m[j] for m in planes], anchor_ids[i][:, None] != ids[j][None, :], least[i], np.full((len(i), 1), _MOST), take)
                        top.add(i[p], s, ids[j[q]])
                    continue
                low, high = (np.frombuffer(c.as_py(), np.int64).reshape(len(a), -1) for c in given)
                low = np.maximum(low, top.least(low.size).reshape(low.shape))
                i, j, s = products(a, planes, (anchor_labels[:, None] != labels[None, :]) & (anchor_ids[:, None] != ids[None, :]), low, high)
                for r in range(ranges):
                    fit = (s >= low[i, r]) & (s <= high[i, r])
                    top.add(i[fit] * ranges + r, s[fit], ids[j[fit]])
        for ab, top in tops.items():
            n = len(top.slot)
            width = max(ranges, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ab)), pa.array(top.slot // width), pa.array((top.slot % width).astype(np.int32)), pa.array(known[ab][top.slot // width]), pa.array(top.ids), pa.array(top.score)], names=["ab", "pos", "range", "anchor_id", "id", "score"])

    more = ["low", "high"] if ranges else []
    met = blocks.join(F.broadcast(anchors), "dims").select("dims", "bits", "ids", "labels", "planes", "ab", "anchor_ids", "anchor_labels", "anchors", *more)
    return met.mapInArrow(run, "ab long, pos long, range int, anchor_id long, id long, score long")


def _with_ranges(anchors: DataFrame, positives: DataFrame, count: int, low: int, high: int) -> DataFrame:
    """Anchor blocks with the ranges of their positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op12")
        for batch in batches:
            lows, highs = [], []
            for ids, found in zip(batch.column("anchor_ids"), batch.column("found").to_pylist(), strict=True):
                ends = np.full((2, len(ids.as_py()) // 8, count), [[[_MOST]], [[_LEAST]]])
                for f in found:
                    ends[:, f["pos"], f["range"]] = -(-low * f["positive_score"] // 100), high * f["positive_score"] // 100
                lows.append(ends[0].tobytes())
                highs.append(ends[1].tobytes())
            kept = [c for c in batch.schema.names if c != "found"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lows, pa.binary()), pa.array(highs, pa.binary())], names=[*kept, "low", "high"])

    found = positives.groupBy("ab").agg(F.collect_list(F.struct("pos", "range", "positive_score")).alias("found"))  # of one block
    return anchors.join(found, "ab").mapInArrow(run, "ab long, slice int, dims long, anchor_ids binary, anchor_labels binary, anchors binary, low binary, high binary")


def _in_slices(blocks: DataFrame, anchors: DataFrame, slices: int, take: int, ranges: int, tag: str) -> DataFrame:
    path = new_path(blocks.sparkSession, tag)
    with settings(blocks.sparkSession, spark_sql_files_maxPartitionBytes="16m"):
        for s in range(slices):
            write_table(_scored(blocks, anchors.where(F.col("slice") == s), take, ranges), f"{path}/slice={s}", rows=16)
    best = Window.partitionBy("ab", "pos", "range").orderBy(F.desc("score"), "id")
    return blocks.sparkSession.read.parquet(path).drop("slice").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= take)


def hard_negatives(rows: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """Per anchor and positive: the first `negatives` rows of other labels whose score lies from low to high per cent of the positive's.

    rows: vec_id, label, embedding; is_anchor: a condition on them. A score is the inner product of the vectors' floor(scale * x) with the
    anchor's; higher ones come first, of equals the smaller vec_id. An anchor's positives are the first rows of its label. Returns
    anchor_id, positive_id, rank, negative_id, positive_score and negative_score; positives without a negative have no row.

    Rows without vec_id, label or vector, or with a null, non-finite or too large component (|floor(scale * x)| over 2^24 with 64
    components, so that scores fit into 64 bits) take no part; vectors of different lengths don't meet. Rows of the anchor's own vec_id
    are neither its positives nor its negatives. A row that repeats counts as often as it stands, but an anchor that repeats is
    answered once for each of its labels and vectors. A positive with a score under zero has no negatives. Empty tables
    give empty results; other columns are not read. All anchors meet all rows: that work is their product, and nothing bounds it but what the planes drop.
    """
    clean = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding", F.expr(is_anchor).alias("_anchor")).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    blocks = materialize(_row_blocks(clean.drop("_anchor"), scale), "negatives-rows")
    chosen = clean.where("_anchor").drop("_anchor").dropDuplicates()
    n, dims = chosen.agg(F.count("*"), F.max(F.size("embedding"))).first()
    slices = math.ceil((n * ((dims or 0) + 2) * 8 + 1) / SLICE_BYTES)
    while True:
        cut = chosen.withColumn("slice", F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(slices)).cast("int"))
        anchors = materialize(_anchor_blocks(cut.repartition(slices, "slice").sortWithinPartitions("slice", "vec_id"), scale), "negatives-anchors")
        largest = anchors.groupBy("slice").agg(F.sum(F.length("anchors")).alias("b")).agg(F.max("b")).first()[0] or 0
        if largest <= 2 * SLICE_BYTES or slices >= n:  # what is broadcast; hashing deals it evenly
            break
        forget(anchors)
        slices *= 2
    found = _in_slices(blocks, anchors, slices, positives, 0, "negatives-positives")
    found = materialize(found.select("ab", "pos", (F.col("rank") - 1).alias("range"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-best")
    with_ranges = materialize(_with_ranges(anchors, found, positives, low, high), "negatives-ranges")
    hard = _in_slices(blocks, with_ranges, slices, negatives, positives, "negatives-found")
    out = hard.drop("anchor_id").join(found, ["ab", "pos", "range"])
    out = materialize(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    forget(blocks, anchors, found, with_ranges)
    return out


#: The same by joining every anchor with every row.
ORACLE = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""
