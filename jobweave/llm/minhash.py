"""MinHash near-dedup with sequential Bayesian verification.

Documents become sets of word shingles; documents of equal sets form a class, and only classes go on. A class's MinHash
signature is cut into bands; classes that share a band are candidates. A pair's signatures are compared batch after
batch, and the pair is dropped as soon as the posterior probability that its similarity reaches the threshold falls
under the chosen miss probability. Survivors are verified exactly on their full shingle sets.

No bucket is expanded into all pairs: members of a large bucket are compared with a hub, then, where a bucket still has several
components, with other hubs; what remains is compared block against block, and only survivors leave a block.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, attach_groups, begin, forget, materialize

ROWS = 4  # hashes a band
BATCH = 16  # hashes that are compared at a time
SMALL = 8  # buckets up to this size are compared pair by pair (28 pairs at most)
HUB_ROUNDS, HUBS = 2, 3
BLOCK, BLOCK_SHINGLES = 512, 400_000  # members and shingles a block, about
PAIRS = 1 << 15  # pairs of a block whose signatures are compared in full at a time
STRETCH = 1 << 20
FOREST = 1 << 20  # links, thinned out, that one task joins: some 100 MB
_rng = np.random.default_rng(17)
_byte = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_word = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
_powers = np.concatenate([np.ones(1, np.uint64), np.full(2 * STRETCH, BASE, np.uint64)]).cumprod(dtype=np.uint64)
_SPACE = re.compile(rb"[\t-\r ]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _long_word(word: memoryview) -> np.ndarray:
    """The hash of a word that is longer than a stretch: the same polynomial, block after block."""
    total = 0
    for k in range(0, len(word), STRETCH):
        value = _byte[np.frombuffer(word[k : k + STRETCH], np.uint8)]
        total += int((value * _powers[: len(value)]).sum(dtype=np.uint64)) * pow(BASE, k, 1 << 64)
    return _mix(np.array([total % (1 << 64)], np.uint64))


def _words_of(part: bytes) -> np.ndarray:
    b = np.frombuffer(part, np.uint8)
    white = _white[b]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64)
    b, white = b[starts[0] :], white[starts[0] :]
    starts = starts - starts[0]
    inside = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    inside[white] = 0
    value = _byte[b] * _powers[inside]
    value[white] = 0
    return _mix(np.add.reduceat(value, starts))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased; words are what white space (space, tab to return) leaves. A word has
    the same hash wherever it stands, and however long it is."""
    data, out, at = text.encode().lower(), [], 0
    while at < len(data):
        end = len(data)
        if end - at > STRETCH and (space := _SPACE.search(data, at + STRETCH)):
            end = space.start()
        if end - at > 2 * STRETCH:
            # The word around at + STRETCH is a long one, and the last up to end.
            cut = max(at - 1, *(data.rfind(bytes([c]), at, at + STRETCH) for c in np.flatnonzero(_white))) + 1
            out += [_words_of(data[at:cut]), _long_word(memoryview(data)[cut:end])]
        else:
            out.append(_words_of(data[at:end]))
        at = end + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, one of none has none."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(len(h) - words + 1, 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(words, len(h))):
        total += h[j : j + n] * _word[j]
    if len(h) < words:
        total += np.uint64(len(h))
    return np.unique(_mix(total))


def plan(threshold: float, miss: float) -> tuple[int, list[int]]:
    """Bands for that miss probability at the threshold; matches needed after each batch of hashes.

    With a uniform prior, P(similarity >= t | m of n hashes match) is the probability that a binomial of n + 1 trials with
    chance t is at most m.
    """
    bands = math.ceil(math.log(miss) / math.log(1 - threshold**ROWS))
    hashes, need = bands * ROWS, []
    for n in [*range(BATCH, hashes, BATCH), hashes]:
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        need.append(m)
    return bands, need


def signature(x: np.ndarray, hashes: int) -> bytes:
    rng = np.random.default_rng(23)
    a, b = (rng.integers(0, 1 << 32, (hashes, 1), dtype=np.uint32) | np.uint32(1) for _ in range(2))
    low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    best = np.full(hashes, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        best = np.minimum(best, (a * low[at : at + 2048] + b * high[at : at + 2048]).min(axis=1))
    return best.astype("<u4").tobytes()


def _signed(docs: DataFrame, words: int, hashes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op6")
        for batch in batches:
            n, digest, sig = [], [], []
            for t in batch.column("text"):
                x = shingles(t.as_py() or "", words)
                n.append(len(x))
                digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                sig.append(signature(x, hashes) if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("at"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "at", "n", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("at"), "text").mapInArrow(run, "doc_id long, at long, n long, digest binary, sig binary")


def _matrix(column, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, hashes)


def _survivors(pairs: DataFrame, sigs: DataFrame, hashes: int, need: list[int]) -> DataFrame:
    """Pairs (a, b) that no batch rules out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op6")
        for batch in batches:
            x, y = _matrix(batch.column("sig_a"), hashes), _matrix(batch.column("sig_b"), hashes)
            left, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
            for k, least in enumerate(need):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches[:] + (x[left, part] == y[left, part]).sum(axis=1)
                stay = matches >= least
                left, matches = left[stay], matches[stay]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(left)), batch.column("b").take(pa.array(left))], names=["a", "b"])

    both = pairs.join(sigs.select(F.col("digest").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("digest").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links: pairs whose full sets reach the threshold. Pairs are grouped by a; its text comes once for each (a, salt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op6")
        of, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            links = []
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text"), strict=True):
                x = shingles(text.as_py(), words)
                if b is None:
                    of, own = a, x
                    continue
                assert of == a
                common = len(np.intersect1d(own, x, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(x) - common):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.binary()) for i in (0, 1)], names=["a", "b"])

    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(32)).cast("int"))
    first = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("digest", "a"), "a").select("a", "salt", F.lit(None).cast("binary").alias("b"), "text")
    rest = salted.join(texts.withColumnRenamed("digest", "b"), "b").select("a", "salt", "b", "text")
    return first.unionByName(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).select("a", "b", "text").mapInArrow(run, "a binary, b binary")


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node is at both ends, and each larger node has one edge: then b is the root of a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as stars: each node but the least of its component, with that least one."""
    begin("components")
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    a, b = (pa.concat_arrays([t.column(c) for t in tables]) for c in ("a", "b"))
    nodes = pc.unique(pa.concat_arrays([a, b]))
    nodes = nodes.take(pc.sort_indices(nodes))
    x, y = (pc.index_in(c, value_set=nodes).to_numpy() for c in (a, b))
    top = np.arange(len(nodes))
    while (apart := top[x] != top[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(top, np.maximum(top[x], top[y]), np.minimum(top[x], top[y]))
        while not np.array_equal(up := top[top], top):
            top = up
    odd = np.flatnonzero(top != np.arange(len(top)))
    for at in range(0, len(odd), 1 << 16):
        part = odd[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(part)), nodes.take(pa.array(top[part]))], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b) but the roots; a root is its component's least node. Each task first thins its
    edges out to stars. If no more than FOREST are left in all, one task joins them; more take alternating large-star and
    small-star steps until only stars are left, in which neighbours are never gathered: a node's least neighbour is pre-aggregated, and
    comes back salted. Both ways give the same rows."""
    kind = edges.schema["a"].dataType.simpleString()
    edges = materialize(edges.select("a", "b").mapInArrow(_forest, f"a {kind}, b {kind}"), "edges")
    few = edges.limit(FOREST + 1).count() <= FOREST
    if few:
        old, edges = edges, materialize(edges.coalesce(1).mapInArrow(_forest, f"a {kind}, b {kind}"), "edges")
        forget(old)
    while not few and not _are_stars(edges):
        # Large-star: the larger neighbours of a node go to its least neighbour, or to itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = attach_groups(both, ["a"], [F.min("b").alias("m")], [F.min("m").alias("m")], salt=F.col("b"))
        large = near.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        # Small-star: a node and its smaller neighbours go to the least of them.
        near = attach_groups(large, ["a"], [F.min("b").alias("m")], [F.min("m").alias("m")], salt=F.col("b"))
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
        old, edges = edges, materialize(small.where("a <> b").distinct(), "edges")
        forget(old)
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct() if not few else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._jw_path = edges._jw_path
    return out


def _set_table(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op6")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([shingles(t.as_py(), words).tobytes() for t in batch.column("text")], pa.binary())], names=["digest", "members"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, members binary")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products of incidence matrices over slices of the vocabulary."""
    known = np.unique(np.concatenate([*left, *right]))
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(known), 8192):
        part = known[at : at + 8192]
        sides = []
        for sets in (left, right):
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                m[i, np.searchsorted(part, s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")])] = 1
            sides.append(m)
        total += sides[0] @ sides[1].T
    return total


def _links_between(band: int, us: list[tuple], vs: list[tuple], percent: int, hashes: int, need: list[int]) -> Iterator[tuple[bytes, bytes]]:
    """Links of the members (digest, root, signature, set) of two blocks that join their components. A pair that shares several bands
    is compared in the first one; survivors of the signatures are verified on full sets."""
    x, y = (np.frombuffer(b"".join(r[2] for r in s), "<u4").reshape(-1, hashes) for s in (us, vs))
    number = {r: i for i, r in enumerate({r[1] for r in [*us, *vs]})}
    left, right = (np.array([number[r[1]] for r in s]) for s in (us, vs))
    matches = np.zeros((len(x), len(y)), np.int32)
    for k in range(min(BATCH, hashes)):
        matches += x[:, None, k] == y[None, :, k]
    i, j = np.nonzero((matches >= need[0]) & (left[:, None] != right[None, :]))
    stay = np.zeros(len(i), bool)
    for at in range(0, len(i), PAIRS):
        part = slice(at, at + PAIRS)
        same = x[i[part]] == y[j[part]]
        stay[part] = (same.sum(axis=1) >= need[-1]) & (same.reshape(len(same), hashes // ROWS, ROWS).all(axis=2).argmax(axis=1) == band)
    i, j = i[stay], j[stay]
    if not len(i):
        return
    p, q = np.unique(i), np.unique(j)
    a, b = ([np.frombuffer(s[k][3], np.uint64) for k in at] for s, at in ((us, p), (vs, q)))
    common = _common(a, b)[np.searchsorted(p, i), np.searchsorted(q, j)].astype(np.int64)
    size = np.array([len(us[k][3]) // 8 for k in i]) + np.array([len(vs[k][3]) // 8 for k in j]) - common
    top = list(range(len(number)))
    for k in np.flatnonzero(100 * common >= percent * size):
        r, s = (_find(top, int(side[at[k]])) for side, at in ((left, i), (right, j)))
        if r != s:
            top[r] = s
            yield us[i[k]][0], vs[j[k]][0]


def _block_links(open_: DataFrame, sigs: DataFrame, texts: DataFrame, words: int, percent: int, hashes: int, need: list[int]) -> DataFrame:
    """Links among all pairs of different components in the open buckets: blocks of the members outside each bucket's core
    component (side u) against blocks of all members (side v). Of the links found only those that join components leave a pair
    of blocks. Blocks are runs of sorted rows, never one value: sorting spills, and a worker holds two blocks."""
    sets = _set_table(texts.join(open_.select("digest").distinct(), "digest", "left_semi"), words)
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = open_.select("bucket", "band", "digest", "root", "core", blocks.alias("blocks"), F.pmod(F.xxhash64("digest"), blocks).cast("int").alias("block"))
    odd = placed.where("root <> core")
    u = odd.select("bucket", "band", "digest", "root", F.col("block").alias("of"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"))
    taken = odd.groupBy("bucket").agg(F.collect_set("block").alias("taken"))
    v = attach_by_key(placed, taken, "bucket", F.col("digest")).select("bucket", "band", "digest", "root", F.explode("taken").alias("of"), "block", F.lit(1).alias("side"))
    known = u.unionByName(v).join(sigs.select("digest", "sig").join(sets, "digest"), "digest")

    def links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
        key, band, sides = None, 0, ([], [])
        for batch in batches:
            at = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "of", "block")), strict=True))
            bands, which = batch.column("band").to_pylist(), batch.column("side").to_pylist()
            for k, member in enumerate(zip(*(batch.column(c) for c in ("digest", "root", "sig", "members")), strict=True)):
                if at[k] != key:
                    if sides[0]:
                        yield from _links_between(band, *sides, percent, hashes, need)
                    key, band, sides = at[k], bands[k], ([], [])
                sides[which[k]].append(tuple(x.as_py() for x in member))
        if sides[0]:
            yield from _links_between(band, *sides, percent, hashes, need)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op6")
        links = links_of(batches)
        while some := list(islice(links, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*some, strict=True)], names=["a", "b"])

    dealt = known.repartition("bucket", "of", "block").sortWithinPartitions("bucket", "of", "block", "side", "digest")
    return dealt.select("bucket", "of", "block", "band", "side", "digest", "root", "sig", "members").mapInArrow(run, "a binary, b binary").distinct()


def _find(top: list[int], x: int) -> int:
    while top[x] != x:
        top[x] = x = top[top[x]]
    return x


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept (doc_id is it), at
    (a hash of the text, which tells apart texts of one doc_id).

    Links join documents with 100 * intersection >= percent * union. Null texts and texts without words have no shingles
    and no links. A null doc_id is the largest; a component of null ids only has a null id, and its rows are kept. Rows that
    repeat a doc_id are nodes of their own by text, so one doc_id may be in several components. Other columns are
    ignored; an empty table gives an empty result.
    """
    return _components(docs, words, percent, miss)[0].drop("root")


def _components(docs: DataFrame, words: int, percent: int, miss: float = 1e-6) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of near_duplicates, and root, which names the component (null where nothing is linked); the tables that these
    rows are read from."""
    bands, need = plan(percent / 100, miss)
    hashes = bands * ROWS
    signed = materialize(_signed(docs, words, hashes), "signatures")
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    least = F.min(F.struct(last.alias("order"), "doc_id", "at", "n", "sig")).alias("r")
    classes = materialize(signed.where("digest IS NOT NULL").groupBy("digest").agg(least, F.count("*").alias("copies")).select("digest", "r.doc_id", "r.at", "r.n", "r.sig", "copies"), "classes")

    spread = classes.select("digest", "n", F.expr(f"posexplode(transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(sig, i * {4 * ROWS} + 1, {4 * ROWS})))) AS (band, bucket)"))
    totals = [F.sum("m").alias("m"), F.sum("total").alias("total"), F.min("hub").alias("hub")]
    grouped = attach_groups(spread, ["bucket"], [F.count("*").alias("m"), F.sum("n").alias("total"), F.min("digest").alias("hub")], totals, salt=F.col("digest"), having=F.col("m") > 1)
    members = materialize(grouped.where("m > 1"), "buckets")

    small = members.where(f"m <= {SMALL}").groupBy("bucket").agg(F.array_sort(F.collect_set("digest")).alias("d"))
    small = small.where("size(d) > 1").select(F.expr("explode(flatten(transform(sequence(1, size(d) - 1), i -> transform(slice(d, i + 1, size(d)), x -> struct(d[i - 1] AS a, x AS b))))) AS p")).select("p.a", "p.b")
    large = members.where(f"m > {SMALL}")
    # Texts of the classes that have any candidate, once.
    sought = members.select("digest").distinct().join(classes, "digest").select("digest", F.coalesce("doc_id", F.lit(-1)).alias("id"), "at")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64("text").alias("at"), "text").where("text IS NOT NULL")
    texts = materialize(texts.join(sought, ["id", "at"]).dropDuplicates(["digest"]).select("digest", "text"), "texts")

    links = roots = None
    for turn in range(HUB_ROUNDS + 1):
        placed = large.select("bucket", "band", "digest", "m", "total")
        if roots is None:
            placed = placed.withColumn("root", F.col("digest"))
        else:
            placed = attach_by_key(placed, roots.withColumnRenamed("node", "digest"), "digest", F.col("bucket")).withColumn("root", F.coalesce("root", "digest"))
        hubs = [F.min(F.struct(F.xxhash64("digest", F.lit(turn * HUBS + k)).alias("h"), "digest", "root")).alias(f"hub{k}") for k in range(HUBS)]
        again = [F.min(f"hub{k}").alias(f"hub{k}") for k in range(HUBS)]
        open_ = attach_groups(placed, ["bucket"], [F.min("root").alias("core"), F.max("root").alias("top"), *hubs], [F.min("core").alias("core"), F.max("top").alias("top"), *again], salt=F.col("digest"), having=F.col("core") != F.col("top"))
        open_ = materialize(open_.where("core IS NOT NULL"), "open")
        if turn and open_.isEmpty():
            forget(open_)
            break
        if turn < HUB_ROUNDS:
            # A member meets the hubs of its largest open bucket; copies share most of their buckets.
            widest = open_.groupBy("digest", "root").agg(F.max(F.struct("m", "bucket", *(f"hub{k}" for k in range(HUBS)))).alias("x"))
            chosen = F.explode(F.array(*(F.col(f"x.hub{k}") for k in range(HUBS)))).alias("hub")
            more = widest.select("digest", "root", chosen).where("root <> hub.root").select(F.least("digest", "hub.digest").alias("a"), F.greatest("digest", "hub.digest").alias("b"))
            more = (more if turn else more.unionByName(small)).distinct()
            found = _verified(_survivors(more, classes, hashes, need), texts, words, percent)
        else:
            found = _block_links(open_, classes, texts, words, percent, hashes, need)
        fresh = materialize(found, "links")
        forget(open_)
        if not turn or not fresh.isEmpty():
            links = fresh if links is None else links.unionByName(fresh)
            old, roots = roots, connected_components(links)
            forget(old)
    forget(members, texts)

    id_of = classes.select("digest", "doc_id", "copies").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    named = attach_groups(id_of, ["root"], [F.min("doc_id").alias("component"), F.count("*").alias("k")], [F.min("component").alias("component"), F.sum("k").alias("k")], salt=F.col("digest"))
    facts = named.where("k > 1 OR copies > 1").select("digest", "component", "root")
    out = attach_by_key(signed.select("doc_id", "at", "n", "digest"), facts, "digest", F.col("doc_id")).withColumn("component_id", F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "at", "root")
    return out, [signed, classes, roots]


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with all its columns: the one of the least doc_id, then of the least hash of its text where
    rows of one doc_id, or of none, are linked. Rows that repeat the kept document go too; documents that are linked with nothing stay."""
    found, tables = _components(docs, words, percent)
    id_, at = F.coalesce("doc_id", F.lit(-1)).alias("__jw_id"), F.col("at").alias("__jw_at")
    alone = F.col("root").isNull()
    # How often each kept row stands in the table; then one of each component, and all that are linked with nothing.
    each = found.where("kept").groupBy("root", id_, at).agg(F.count("*").alias("__jw_n"))
    one = each.groupBy("root", F.when(alone, F.col("__jw_id")), F.when(alone, F.col("__jw_at"))).agg(F.min(F.struct("__jw_id", "__jw_at", "__jw_n")).alias("k"))
    kept = materialize(one.select("k.*"), "kept")
    forget(*tables)
    rows = docs.withColumn("__jw_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn("__jw_at", F.xxhash64("text"))
    # The small side is hashed, so texts are not sorted; adaptive execution splits a row that is repeated very often.
    rows = rows.join(kept.hint("shuffle_hash"), ["__jw_id", "__jw_at"])
    if kept.where("__jw_n > 1").isEmpty():
        return rows.select(*docs.columns)
    rows = materialize(rows.withColumn("__jw_salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int")), "kept-rows")
    again = rows.where("__jw_n > 1").dropDuplicates(["__jw_id", "__jw_at", "__jw_salt"]).dropDuplicates(["__jw_id", "__jw_at"])
    return rows.where("__jw_n = 1").unionByName(again).select(*docs.columns)
