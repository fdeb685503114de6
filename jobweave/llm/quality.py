"""Quality classifier: supervised subword embeddings.

Each whole text becomes hashed features: its words, pairs of neighbouring words, and character n-grams of three and four (white
space counts as one kind of character). Feature vectors are learned with a softmax output by stochastic gradient descent in numpy, on a bounded sample of labelled
rows. A text's vector is the mean of its features' vectors; as the output is linear in it, scoring sums one learned number
a feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import begin, held_out

BITS = 15  # buckets of each kind of feature: words, pairs of words, 3-grams and 4-grams of characters
KINDS = 4
#: Labelled rows a class that the model is fitted on, at most. Each has at most KINDS << BITS features (a MB), whatever its length.
SAMPLE_PER_CLASS = 1500
DIM, EPOCHS, RATE, SEED = 8, 8, 60.0, 11
STRETCH = 1 << 19  # characters of a text that are handled at once


#: White space characters (code points): between words.
_WHITE = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_BLANK = "".join(map(chr, [*range(33), *_WHITE]))
_powers = np.random.default_rng(5).integers(1, 1 << 32, 64, dtype=np.uint32) | np.uint32(1)


def _bucket(mixed: np.ndarray, kind: int) -> np.ndarray:
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(2654435761) >> np.uint32(32 - BITS)) + np.uint32(kind << BITS)


def buckets(text: str) -> Iterator[np.ndarray]:
    """Feature buckets (with repeats) of a whole text, half a million characters at a time. What a cut goes through is carried over:
    the characters before it, the word that it stands in and the word before that."""
    if not text.strip(_BLANK):
        return
    before, open_, length, last = np.array([32], np.uint32), np.uint32(0), 0, np.zeros(0, np.uint32)
    for at in range(0, max(len(text), 1), STRETCH):
        part = text[at : at + STRETCH] + (" " if at + STRETCH >= len(text) else "")
        b = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        # White space is rare above 0x20, and the table is sorted.
        white = (b <= 32) | ((b > 126) & np.isin(b, _WHITE)) if int(b.max()) > 126 else b <= 32
        b = np.where(white, np.uint32(32), b)
        starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
        goes_on = before[-1] != 32 and not white[0]
        if before[-1] != 32 and white[0]:  # the word ended with the part before
            word, open_, length = np.array([open_], np.uint32), np.uint32(0), 0
        else:
            word = np.zeros(0, np.uint32)
        if len(starts):
            # A word's hash is the sum of its characters, weighted by their places in the word.
            inside = np.arange(len(b) - starts[0]) - np.repeat(starts - starts[0], np.diff(np.append(starts, len(b))))
            if goes_on:
                inside[: starts[1] if len(starts) > 1 else len(b)] += length
            mixed = (b[starts[0] :] + np.uint32(1)) * _powers[inside & 63]
            mixed[white[starts[0] :]] = 0
            sums = np.add.reduceat(mixed, starts - starts[0], dtype=np.uint32)
            if goes_on:
                sums[:1] += open_
            if white[-1]:
                open_, length = np.uint32(0), 0
            else:
                open_, length, sums = sums[-1], int(inside[-1]) + 1, sums[:-1]
            word = np.concatenate([word, sums])
        pairs = np.concatenate([last, word])
        last = pairs[-1:]
        # n-grams of characters run on over spaces, as how words follow each other tells quality too.
        b = np.concatenate([before, b])
        m, n = [b * p for p in _powers[:4]], len(before)
        three, four = m[0][:-2] + m[1][1:-1] + m[2][2:], m[0][:-3] + m[1][1:-2] + m[2][2:-1] + m[3][3:]
        yield np.concatenate([_bucket(word, 0), _bucket(pairs[:-1] * _powers[4] + pairs[1:] * _powers[5], 1), _bucket(three[max(n - 2, 0) :], 2), _bucket(four[max(n - 3, 0) :], 3)])
        before = b[-3:]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their shares."""
    count = np.zeros(KINDS << BITS, np.float64)
    for part in buckets(text):
        count += np.bincount(part, minlength=len(count))
    at = np.flatnonzero(count)
    return at.astype(np.int32), (count[at] / max(count.sum(), 1)).astype(np.float32)


@dataclass
class Model:
    weight: np.ndarray  # of each bucket, towards label 1
    bias: float

    def score(self, text: str) -> float:
        total, n = 0.0, 0
        for at in buckets(text):
            total += float(self.weight[at].sum(dtype=np.float64))
            n += len(at)
        return float(1 / (1 + np.exp(-np.clip(total / max(n, 1) + self.bias, -30, 30))))


def gradients(vectors: np.ndarray, share: np.ndarray, out: np.ndarray, bias: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of a text's cross-entropy by its features' vectors, the output weights and the biases."""
    hidden = share @ vectors
    z = hidden @ out + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[y] -= 1
    return share[:, None] * (out @ p)[None, :], np.outer(hidden, p), p


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], priors: tuple[float, float]) -> Model:
    """rows: buckets, shares and label. priors: the labels' weights, so that a sample balanced by class gives the
    probabilities of all labelled rows. With one class only, or none, the score is constant."""
    present = {y for _, _, y in rows}
    if len(present) < 2:
        return Model(np.zeros(KINDS << BITS, np.float32), {frozenset(): 0.0, frozenset([0]): -5.0, frozenset([1]): 5.0}[frozenset(present)])
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (KINDS << BITS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            at, share, y = rows[k]
            rate = 1 - done / steps
            done += 1
            dvector, dout, dbias = gradients(vectors[at], share, out, bias, y)
            out -= np.float32(0.2 * rate) * dout
            bias -= np.float32(0.05 * rate) * dbias
            vectors[at] -= np.float32(RATE * rate) * dvector
    diff = out[:, 1] - out[:, 0]
    shift = float(np.log(priors[1] / priors[0]))
    return Model((vectors @ diff).astype(np.float32), float(bias[1] - bias[0]) + shift)


def train(docs: DataFrame, labels: DataFrame, eligible: Column, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits on at most about per_class rows of each label, drawn by a hash of doc_id; eligible may refer to doc_id only."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & F.coalesce(eligible, F.lit(False))).select("doc_id", F.col("quality").alias("y"))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < F.when(F.col("y") == 1, 1_000_000 * min(1, per_class / n.get(1, 1))).otherwise(1_000_000 * min(1, per_class / n.get(0, 1)))
    # The draw is near per_class a class; the limit makes the bound certain.
    drawn = F.broadcast(rows.where(draw).orderBy(F.xxhash64("doc_id", F.lit(8))).limit(int(2.5 * per_class)))
    texts = docs.select("doc_id", "text").join(drawn, "doc_id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op1")
        for batch in batches:
            found = [features(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], names=["doc_id", "y", "at", "share"])

    got = texts.select(F.col("doc_id").cast("long"), F.col("y").cast("int"), "text").mapInArrow(featurise, "doc_id long, y int, at array<int>, share array<float>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    sample = [(np.asarray(a.values, np.int32), np.asarray(s.values, np.float32), y.as_py()) for a, s, y in zip(got["at"], got["share"], got["y"], strict=True)]
    drawn_n = {k: sum(1 for r in sample if r[2] == k) for k in (0, 1)}
    return fit(sample, tuple(n.get(k, 0) / max(drawn_n[k], 1) or 1.0 for k in (0, 1)))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Learns from labels.quality of rows whose crc32(doc_id) mod 3 is not 1. Null text counts as empty; an empty text gets the
    score of no features. Rows with a null doc_id are scored, not learned from, and not held out; labels other than 0 and 1
    are not learned from. Repeated rows give repeated results; extra columns are ignored. Without labels of both
    classes the score is constant (0.5 without any).
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, ~held_out(F.col("doc_id"))))  # 400 KB, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op1")
        m = model.value
        for batch in batches:
            score = [m.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
