"""Language identification by a byte convolutional network, in numpy.

A text's UTF-8 bytes are cut into windows of a fixed length. Bytes become learned vectors; filters two, three and four bytes
wide run over a window, each filter's largest value stays, and softmax gives the languages. The windows' probabilities
are averaged over the whole text, by their bytes. Trained by stochastic gradient descent on labelled snippets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import begin, held_out

WINDOW, DIM, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 12
#: Labelled rows a language that the model is fitted on, at most; each gives two snippets of a window's length.
SAMPLE_PER_LANG = 400
#: And of all languages together; of more languages than that, the most frequent are learned.
SAMPLE_ROWS = 20_000
EPOCHS, BATCH, RATE, SEED = 12, 32, 0.15, 3
BLOCK = 64  # windows that are handled at once


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray  # 256 x DIM; byte 0, which pads, stays zero
    kernel: np.ndarray  # (4 * DIM) x filters; narrower filters have zeros behind
    bias: np.ndarray
    out: np.ndarray  # filters x languages
    out_bias: np.ndarray

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([self._pass(windows[i : i + BLOCK])[-1] for i in range(0, len(windows), BLOCK)])

    def _pass(self, windows: np.ndarray):
        n, wide = len(windows), max(WIDTHS)
        vectors = self.embed[windows]
        size = vectors.strides[-1]
        seen = np.lib.stride_tricks.as_strided(vectors, (n, WINDOW - wide + 1, wide * DIM), (WINDOW * DIM * size, DIM * size, size))
        seen = np.ascontiguousarray(seen)
        values = (seen.reshape(-1, wide * DIM) @ self.kernel).reshape(n, WINDOW - wide + 1, -1)
        pooled = np.maximum(values.max(axis=1) + self.bias, 0)
        z = pooled @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return seen, values, pooled, p / p.sum(axis=1, keepdims=True)

    def predict(self, text: str) -> tuple[str, float]:
        windows, weight = cut(text)
        mean = weight @ self.probabilities(windows)
        best = int(mean.argmax())
        return self.langs[best], float(min(mean[best], 1.0))


def cut(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the whole text, the last one padded, and their shares of its bytes."""
    data = text.encode().replace(b"\0", b" ")
    n = max(1, -(-len(data) // WINDOW))
    windows = np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)
    weight = np.full(n, WINDOW, np.float32)
    weight[-1] = len(data) - (n - 1) * WINDOW
    return windows, weight / max(weight.sum(), 1)


def gradients(model: Model, windows: np.ndarray, y: np.ndarray, weight: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean weighted cross-entropy, by parameter. mask: where narrow filters have no weights."""
    seen, values, pooled, p = model._pass(windows)
    p[np.arange(len(y)), y] -= 1
    dz = p * weight[:, None] / len(y)
    dpool = (dz @ model.out.T) * (pooled > 0)
    place = values.argmax(axis=1)  # where each filter was largest
    rows = np.arange(len(y))[:, None]
    dembed = np.zeros_like(model.embed)
    back = dpool[:, :, None] * model.kernel.T[None]
    for j in range(max(WIDTHS)):
        np.add.at(dembed, windows[rows, place + j], back[:, :, j * DIM : (j + 1) * DIM])
    dembed[0] = 0
    return {"embed": dembed, "kernel": np.einsum("nf,nfi->if", dpool, seen[rows, place]) * mask, "bias": dpool.sum(axis=0), "out": pooled.T @ dz, "out_bias": dz.sum(axis=0)}


def kernel_mask() -> np.ndarray:
    return np.concatenate([np.repeat([[1.0]] * w * DIM + [[0.0]] * (max(WIDTHS) - w) * DIM, FILTERS, axis=1) for w in WIDTHS], axis=1).astype(np.float32)


def fit(snippets: list[tuple[str, str]]) -> Model:
    """snippets: text and language. Classes weigh alike, however many snippets they have."""
    langs = sorted({x for _, x in snippets})
    rng = np.random.default_rng(SEED)
    filters = FILTERS * len(WIDTHS)
    mask = kernel_mask()
    model = Model(langs, rng.normal(0, 0.5, (256, DIM)).astype(np.float32), rng.normal(0, 0.35, (max(WIDTHS) * DIM, filters)).astype(np.float32) * mask, np.zeros(filters, np.float32), np.zeros((filters, len(langs)), np.float32), np.zeros(len(langs), np.float32))
    model.embed[0] = 0
    if not snippets:
        return model
    windows = np.concatenate([cut(t)[0][:1] for t, _ in snippets])
    at = {x: k for k, x in enumerate(langs)}
    y = np.array([at[x] for _, x in snippets])
    weight = (len(y) / len(langs) / np.bincount(y, minlength=len(langs)))[y].astype(np.float32)
    steps, done = EPOCHS * -(-len(y) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            k = order[at : at + BATCH]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            grad = gradients(model, windows[k], y[k], weight[k], mask)
            for name, g in grad.items():
                setattr(model, name, getattr(model, name) - rate * g)
            model.embed[0] = 0
    return model


def train(docs: DataFrame, eligible: Column, per_lang: int = SAMPLE_PER_LANG, most: int = SAMPLE_ROWS) -> Model:
    """Fits on about per_lang rows of each language and at most about `most` in all, drawn by a hash of doc_id, two snippets at
    hashed places of each."""
    known = docs.where(F.col("lang").isNotNull() & F.coalesce(eligible, F.lit(False)))
    counts = known.groupBy("lang").agg(F.count("*").alias("__jw_n")).orderBy(F.col("__jw_n").desc(), "lang").limit(most).collect()
    if not counts:
        return fit([])
    per_lang = min(per_lang, max(1, most // len(counts)))
    # At most `most` rows of a language and a number.
    counts = docs.sparkSession.createDataFrame(counts, "lang string, __jw_n long")
    drawn = known.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text").join(F.broadcast(counts), "lang")
    drawn = drawn.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) * F.col("__jw_n") < 1_000_000 * per_lang)
    place = lambda k: F.expr(f"substring(text, cast(1 + pmod(xxhash64(doc_id, {k}), greatest(char_length(text) - {WINDOW}, 1)) AS int), {WINDOW})")
    got = drawn.select("doc_id", "lang", F.explode(F.array(place(1), place(2))).alias("snippet")).orderBy(F.xxhash64("doc_id", F.lit(6))).limit(2 * min(2 * most, 2 * per_lang * counts.count()))
    return fit([(r["snippet"], r["lang"]) for r in sorted(got.collect(), key=lambda r: (r["doc_id"], r["snippet"])) if any(map(str.isalpha, r["snippet"]))])


UNKNOWN = "und"


def predict_language(docs: DataFrame) -> DataFrame:
    """The documents' columns, and held_out, lang_pred, score.

    Learns from text and lang of rows whose crc32(doc_id) mod 3 is not 1; rows with a null doc_id, lang or text are not learned
    from. A null text, or one without a letter, gets `und` and score 0; so does every text if nothing could be learned.
    Ties go to the language first in order. Repeated rows give repeated results; columns named like the new ones
    are replaced. An empty table gives an empty result.
    """
    return _predicted(docs.drop("held_out", "lang_pred", "score"), "held_out", "lang_pred", "score")


def keep_known_languages(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents (all their columns as they were) whose language is known with at least that score."""
    return _predicted(docs, "__jw_held_out", "__jw_lang_pred", "__jw_score").where((F.col("__jw_lang_pred") != UNKNOWN) & (F.col("__jw_score") >= least)).select(*docs.columns)


def _predicted(docs: DataFrame, held: str, lang: str, score: str) -> DataFrame:
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, ~held_out(F.col("doc_id"))))  # some KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op8")
        m = model.value
        for batch in batches:
            found = []
            for t in batch.column("text"):
                text = t.as_py()
                known = m.langs and text and next(filter(str.isalpha, text), None)
                found.append(m.predict(text) if known else (UNKNOWN, 0.0))
            new = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, lang, score])

    rows = docs.withColumn(held, F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    schema = StructType(list(rows.schema.fields)).add(lang, StringType()).add(score, DoubleType())
    return rows.mapInArrow(run, schema)
