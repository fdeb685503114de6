"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are computed in Arrow batches; equal ones form a class, and only classes go on. Classes are sorted by the Gray rank of
their fingerprint and dealt over groups of neighbours in that order. A tree stands over each group: a node keeps the bits that all
its members share, as a mask and a pattern. Two trees are walked together from the top; at each step only bits that both nodes
share and no node above them did are compared, the differences are added up, and a pair of nodes goes as soon as they exceed the limit.
A tree of the same kind over the groups themselves says which groups must meet at all.

A pair of groups gives back a spanning forest of its links, never the links themselves, and node pairs that are linked already are
not walked again, so that a crowd of near copies costs no more rows than it has members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, attach_groups, begin, forget, materialize
from .minhash import connected_components

SEED = 42
GROUP = 1 << 16  # fingerprints a group, and groups a node above them, about
CHUNK = 1 << 17  # node pairs that are compared at a time
STRETCH = 1 << 20  # bytes of text whose words are cut at a time
_WHITE = b" \t\n\r\x0b\x0c"


def _stretches(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some MB at a time; no word is cut."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > STRETCH:
            found = [k for c in _WHITE if (k := data.find(c, at + STRETCH)) >= 0]
            end = min(found, default=end)
        yield data[at:end].split()
        at = end


def _bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit."""
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # sums of 255 bits fit into a byte
    return bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The SimHash of a text in UTF-8; of fewer words than a shingle has, the whole sequence is one; without words, zero."""
    counts, total, last = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for some in _stretches((text or b"").lower()):
        some = last + some
        if len(some) >= words:
            joined = b" ".join(some)
            size = np.fromiter(map(len, some), np.int64, len(some))
            ends = np.cumsum(size + 1) - 1
            found = [digest(joined[s:e], SEED) for s, e in zip((ends - size)[: len(some) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
            counts += _bit_counts(found)
            total += len(found)
        last = some[-(words - 1) :] if words > 1 else []
    if not total and last:
        return digest(b" ".join(last), SEED)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def _fingerprints(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op13")
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Where a fingerprint stands in the order of the Gray code; the sign bit is turned so that signed numbers sort like unsigned."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _grouped(leaves: DataFrame, order: Column, columns: list[str]) -> DataFrame:
    """Groups of neighbours in that order, one row each: number, AND and OR of the members' bits, and the columns (longs) one after
    the other. The last two columns are a member's own AND and OR; a single column is both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op13")
        parts = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches if batch.num_rows]
        if parts:
            all_ = np.concatenate(parts, axis=1)
            low, high = all_[-2:] if len(all_) > 1 else (all_[0], all_[0])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (TaskContext.get().partitionId(), int(np.bitwise_and.reduce(low)), int(np.bitwise_or.reduce(high)))] + [pa.array([all_.tobytes()], pa.binary())], names=["g", "low", "high", "members"])

    n = max(1, math.ceil(leaves.count() / GROUP))
    return leaves.select(*columns, order.alias("_order")).repartitionByRange(n, "_order").sortWithinPartitions("_order").select(*columns).mapInArrow(run, "g long, low long, high long, members binary")


class _Tree:
    """Nodes over runs of 1, 2, 4, ... leaves: the bits that all leaves below share (mask) and their values (pattern)."""

    def __init__(self, low: np.ndarray, high: np.ndarray, height: int):
        self.masks, self.patterns = [], []
        for _ in range(height + 1):
            self.masks.append(~(low ^ high))
            self.patterns.append(low)
            at = np.arange(0, len(low), 2)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)


class _Links:
    """Components of the leaves of two trees (the second is None if it is the first)."""

    def __init__(self, n: int, m: int):
        self.top, self.n, self.m, self.joins, self.known = np.arange(n + m), n, m, 0, None

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        top = self.top
        while True:
            x, y = top[a], top[b]
            apart = x != y
            if not apart.any():
                return
            self.joins += int(apart.sum())
            np.minimum.at(top, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
            while not np.array_equal(up := top[top], top):
                top[:] = up

    def same(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        """Which node pairs have all their leaves in one component; None as long as hardly any are joined."""
        if self.joins > (self.n + self.m) >> 6:
            self.joins, self.known = 0, [self._levels(self.top[: self.n]), self._levels(self.top[self.n :] if self.m else self.top)]
        if self.known is None:
            return None
        (least, most), (least2, most2) = (side[min(level, len(side) - 1)] for side in self.known)
        return (least[a] == most[a]) & (least2[b] == most2[b]) & (least[a] == least2[b])

    @staticmethod
    def _levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = [(x, x)]
        while len(out[-1][0]) > 1:
            at = np.arange(0, len(out[-1][0]), 2)
            out.append((np.minimum.reduceat(out[-1][0], at), np.maximum.reduceat(out[-1][1], at)))
        return out


def _close(one: _Tree, two: _Tree | None, limit: int, links: _Links | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs (i, j) whose shared bits differ in `limit` places at most; i <= j if there is only one tree. Pairs that links has
    in one component are left out."""
    other = two or one
    start = np.zeros(1, np.int64)
    stack = [(len(one.masks) - 1, start, start, np.zeros(1, np.uint8), np.zeros(1, np.uint64))]
    entered = False
    while stack:
        level, a, b, found, shared = stack.pop()
        if not entered:  # the two roots
            entered = True
            shared = one.masks[level][a] & other.masks[level][b]
            found = np.bitwise_count((one.patterns[level][a] ^ other.patterns[level][b]) & shared)
            stay = found <= limit
            a, b, found, shared = a[stay], b[stay], found[stay], shared[stay]
        if links is not None and len(a) and (same := links.same(level, a, b)) is not None:
            a, b, found, shared = a[~same], b[~same], found[~same], shared[~same]
        if not len(a):
            continue
        if level == 0:
            yield a, b
            continue
        level -= 1
        a, b = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1]), np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1])
        found, shared = np.tile(found, 4), np.tile(shared, 4)
        stay = (a < len(one.masks[level])) & (b < len(other.masks[level]))
        if two is None:
            stay &= a <= b
        a, b, found, shared = a[stay], b[stay], found[stay], shared[stay]
        more = one.masks[level][a] & other.masks[level][b] & ~shared
        found = found + np.bitwise_count((one.patterns[level][a] ^ other.patterns[level][b]) & more)
        stay = found <= limit
        a, b, found, shared = a[stay], b[stay], found[stay], (shared | more)[stay]
        for at in range(0, len(a), CHUNK):
            part = slice(at, at + CHUNK)
            stack.append((level, a[part], b[part], found[part], shared[part]))


def _height(*sizes: int) -> int:
    return max(sizes).bit_length()


def close_fingerprints(x: np.ndarray, y: np.ndarray | None, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links within x, or between x and y: pairs of fingerprints of the same component. Both are
    unsigned and in Gray order."""
    links = _Links(len(x), 0 if y is None else len(y))
    height = _height(len(x), links.m)
    one, two = _Tree(x, x, height), None if y is None else _Tree(y, y, height)
    for a, b in _close(one, two, limit, links):
        links.add(a, b if y is None else b + len(x))
    all_ = x if y is None else np.concatenate([x, y])
    odd = np.flatnonzero(links.top != np.arange(len(all_)))
    yield all_[odd], all_[links.top[odd]]


def _group_pairs(groups: DataFrame, limit: int) -> DataFrame:
    """Pairs (g, h), g <= h, of groups that may hold a link, from trees over the groups."""
    above = materialize(_grouped(groups, F.col("g"), ["g", "low", "high"]), "simhash-above")
    last = above.agg(F.max("g")).first()[0]
    side = above.select("g", "members")
    pairs = side.select(F.col("g").alias("s"), F.col("members").alias("x"), F.explode(F.sequence("g", F.lit(last or 0))).alias("t"))
    pairs = pairs.join(side.select(F.col("g").alias("t"), F.col("members").alias("y")), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op13")
        for batch in batches:
            for s, t, x, y in zip(*(batch.column(c) for c in ("s", "t", "x", "y")), strict=True):
                (g, low, high), (h, low2, high2) = (np.frombuffer(m.as_py(), np.int64).reshape(3, -1) for m in (x, y))
                height = _height(len(g), len(h))
                one = _Tree(low.view(np.uint64), high.view(np.uint64), height)
                two = None if s == t else _Tree(low2.view(np.uint64), high2.view(np.uint64), height)
                for a, b in _close(one, two, limit, None):
                    yield pa.RecordBatch.from_arrays([pa.array(g[a]), pa.array(h[b])], names=["g", "h"])

    out = materialize(pairs.mapInArrow(run, "g long, h long"), "simhash-pairs")
    forget(above)
    return out


def _links_of(groups: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """Pairs of groups meet in one task each, side after side; both sides come in one shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op13")
        of, own = None, None
        for batch in batches:
            for g, h, side, m in zip(*(batch.column(c) for c in ("g", "h", "side", "members")), strict=True):
                fps = np.frombuffer(m.as_py(), np.uint64)
                if not side.as_py():
                    of, own = (g, h), fps
                    if g != h:
                        continue
                assert of == (g, h)
                for a, b in close_fingerprints(own, None if g == h else fps, limit):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    n = pairs.count()
    tasks = max(1, min(n, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))), n // 8)
    sides = pairs.select("g", "h", F.col("g").alias("of"), F.lit(0).alias("side")).unionByName(pairs.where("g < h").select("g", "h", F.col("h").alias("of"), F.lit(1).alias("side")))
    met = sides.join(groups.select(F.col("g").alias("of"), "members"), "of").select("g", "h", "side", "members")
    return met.repartition(tasks, "g", "h").sortWithinPartitions("g", "h", "side").mapInArrow(run, "a long, b long")


def near_fingerprints(docs: DataFrame, words: int = 3, limit: int = 3) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id, the least doc_id of those reachable over links, itself
    included. Fingerprints link where they differ in `limit` bits at most.

    A null text counts as empty; texts without words have fingerprint zero and are linked like any other. A row that repeats is
    answered as often as it stands. Null doc_ids are never a component's id, but a document without one still links others; where
    a component has no other, its id is null. Texts may have any length. An empty table gives an empty result. Other columns of docs are not read.
    """
    signed = materialize(_fingerprints(docs, words), "simhash-signed", rows=500)
    classes = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "simhash-classes")
    groups = materialize(_grouped(classes, gray_rank(F.col("fp")), ["fp"]), "simhash-groups")
    pairs = _group_pairs(groups.select("g", "low", "high"), limit)
    links = materialize(_links_of(groups, pairs, limit), "simhash-links")
    roots = connected_components(links)
    forget(groups, pairs, links)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = attach_groups(named, ["root"], [F.min("doc_id").alias("component"), F.count("*").alias("k")], [F.min("component").alias("component"), F.sum("k").alias("k")], salt=F.col("fp"))
    facts = named.where("k > 1 OR copies > 1").select("fp", "component")
    out = attach_by_key(signed, facts, "fp", F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id"))
