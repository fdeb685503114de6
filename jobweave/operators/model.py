"""Features and the ordinal model: skills, categories and title TF-IDF, a multinomial regression, out-of-fold scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch
from .ranking import assign_folds, class_weights, expected_rating

TOKEN = r"[\p{L}\p{N}_]{2,}"
MAX_TERMS, MIN_SKILL = 150, 3


def default_stop_words() -> list[str]:
    """English stop words that Spark ships (another list may be passed to every function that takes one)."""
    return StopWordsRemover.loadDefaultStopWords("english")


def skill_vocabulary(rows: DataFrame, least: int = MIN_SKILL) -> DataFrame:
    """Skills named at least so often (repeats in a posting count), by name."""
    return rows.select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def categories(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.coalesce(column, F.lit("unknown")).alias("category")).distinct()


def title_terms(title: Column, stop_words: Sequence[str]) -> Column:
    """Words of two characters or more without stop words, and pairs of neighbours among them."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(*stop_words))
    pair = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i)))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(words), lambda w: F.concat(w, pair(w))), F.lit(0))


def tfidf_vocabulary(rows: DataFrame, stop_words: Sequence[str], most: int = MAX_TERMS) -> DataFrame:
    """term, idf = ln((1 + n) / (1 + df)) + 1, of the terms with the highest counts (ties: by name)."""
    terms = rows.select(title_terms(F.col("title"), stop_words).alias("terms"))
    n = rows.agg(F.count("*").alias("n"))
    counts = terms.select(F.monotonically_increasing_id().alias("row"), F.explode("terms").alias("term")).groupBy("term", "row").count().groupBy("term").agg(F.sum("count").alias("count"), F.count("*").alias("df"))
    top = counts.orderBy(F.col("count").desc(), "term").limit(most)
    return top.select("term", (F.log((1 + n.scalar()) / (1 + F.col("df"))) + 1).alias("idf"))


def _without_each_fold(counts: DataFrame, by: str, sums: Sequence[str], folds: int) -> DataFrame:
    """counts of (by, fold) to those of (by, without): for each fold the totals less the fold's own part."""
    per_fold = F.map_from_entries(F.collect_list(F.struct("fold", F.struct(*sums)))).alias("own")  # as many as there are folds
    total = counts.groupBy(by).agg(*(F.sum(c).alias(c) for c in sums), per_fold)
    each = total.withColumn("without", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return each.select(by, "without", *((F.col(c) - F.coalesce(F.try_element_at("own", "without")[c], F.lit(0))).alias(c) for c in sums))


def fold_vocabularies(dealt: DataFrame, folds: int, stop_words: Sequence[str], key: str = "vacancy_id", least: int = MIN_SKILL, most: int = MAX_TERMS) -> DataFrame:
    """What each fold's model knows: without (the fold left out), kind (skill, seniority, remote or term), term and idf (1 but for
    terms). Names are counted once by fold; a vocabulary is made of the totals less the fold's own counts. dealt has a fold and a key that doesn't repeat."""
    whole = lambda c: F.array(F.coalesce(c, F.lit("unknown")))
    of = {"skill": F.coalesce("skills", F.array().cast("array<string>")), "seniority": whole("seniority"), "remote": whole("remote_policy"), "term": title_terms(F.col("title"), stop_words)}
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), x.alias("names")) for k, x in of.items()))).alias("x")
    rows = dealt.select("fold", key, named).select("fold", key, "x.kind", F.explode("x.names").alias("term"))
    # Of a row's repeats all count, but it is one document.
    each = rows.groupBy("fold", "kind", "term", key).agg(F.count("*").alias("n")).groupBy(F.struct("kind", "term").alias("of"), "fold").agg(F.sum("n").alias("n"), F.count("*").alias("df"))
    counts = _without_each_fold(each, "of", ["n", "df"], folds).where("n > 0").select("without", "of.*", "n", "df")
    sizes = _without_each_fold(dealt.groupBy(F.lit(1).alias("of"), "fold").agg(F.count("*").alias("rows")), "of", ["rows"], folds).drop("of")
    place = F.row_number().over(Window.partitionBy("without", "kind").orderBy(F.col("n").desc(), "term"))
    terms = counts.where("kind = 'term'").withColumn("place", place).where(F.col("place") <= most).drop("place")
    terms = terms.join(F.broadcast(sizes), "without").withColumn("idf", F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1).drop("rows")  # sizes: a row a fold
    rest = counts.where((F.col("kind") != "term") & ((F.col("kind") != "skill") | (F.col("n") >= least))).withColumn("idf", F.lit(1.0))
    return terms.unionByName(rest).select("without", "kind", "term", "idf")


def ordinals(rows: DataFrame, column: str, parts: int = 0) -> DataFrame:
    """Distinct values of the column with their ordinal number in sorted order (nulls first), from 0: ranges are sorted side by side,
    and the driver sees one count a range. The ranges are written once, so that both uses see the same ones."""
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "ordinals")
    ranged = rows.select(column).distinct().repartitionByRange(n, F.col(column).asc_nulls_first()).sortWithinPartitions(F.col(column).asc_nulls_first())
    # The number of the partition above bit 33, the row's number in it below.
    ranged.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    part = F.shiftright("_at", 33).cast("int")
    sizes = sorted((r.part, r.n) for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [0] * (sizes[-1][0] + 1 if sizes else 1), 0
    for k, size in sizes:
        starts[k], total = total, total + size
    start = F.element_at(F.lit(starts).cast("array<bigint>"), part + 1)
    return kept.select(column, (start + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("ordinal"))


def multi_hot(rows: DataFrame, key: str, skills: str = "skills", least: int = MIN_SKILL) -> DataFrame:
    """key, ordinal, skill: a row's known skills, each once, by their place in the sorted vocabulary. The vocabulary is attached by a
    join and is never gathered, however many skills there are."""
    named = rows.select(key, F.explode(F.array_distinct(skills)).alias("skill"))
    known = ordinals(skill_vocabulary(rows.withColumn("skills", F.col(skills)), least), "skill")
    return named.join(known, "skill").select(key, "ordinal", "skill")


def tfidf(rows: DataFrame, vocabulary: DataFrame, key: str, stop_words: Sequence[str]) -> DataFrame:
    """key, term, weight (L2-normalised a row); rows without a known term have none."""
    terms = rows.select(key, F.explode(title_terms(F.col("title"), stop_words)).alias("term")).join(F.broadcast(vocabulary), "term")
    each = terms.groupBy(key, "term").agg((F.count("*") * F.max("idf")).alias("w"))
    norm = each.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return each.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


@dataclass
class Features:
    """A fitted vocabulary; `assemble` gives a row's features in its order, as a sparse vector."""

    skills: list[str] = field(default_factory=list)
    seniority: list[str] = field(default_factory=list)
    remote: list[str] = field(default_factory=list)
    terms: list[tuple[str, float]] = field(default_factory=list)
    stop_words: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, rows: DataFrame, stop_words: Sequence[str] | None = None) -> Features:
        stop = list(default_stop_words() if stop_words is None else stop_words)
        names = lambda df: sorted(r[0] for r in df.collect())
        terms = sorted((r["term"], r["idf"]) for r in tfidf_vocabulary(rows, stop).collect())
        return cls(names(skill_vocabulary(rows).select("skill")), names(categories(rows, "seniority")), names(categories(rows, "remote_policy")), terms, stop)

    def names(self) -> list[str]:
        return [*(f"skill:{s}" for s in self.skills), *(f"seniority_{s}" for s in self.seniority), *(f"remote_{s}" for s in self.remote), *(f"title:{t}" for t, _ in self.terms)]

    def assemble(self, rows: DataFrame, output: str = "features") -> DataFrame:
        """rows with the sparse vector. Its plan does not grow with the vocabulary."""
        known = lambda c: F.array(F.coalesce(c, F.lit("unknown")))
        inputs = {"_skills": F.coalesce("skills", F.array().cast("array<string>")), "_seniority": known("seniority"), "_remote": known("remote_policy"), "_terms": title_terms(F.col("title"), self.stop_words)}
        vocabularies = {"_skills": self.skills, "_seniority": self.seniority, "_remote": self.remote, "_terms": [t for t, _ in self.terms]}
        out, parts = rows.withColumns(inputs), []
        for name, words in vocabularies.items():
            if words:
                out = CountVectorizerModel.from_vocabulary(words, name, f"{name}_counts").setBinary(name != "_terms").transform(out)
                parts.append(f"{name}_counts")
        if self.terms:
            out = ElementwiseProduct(scalingVec=Vectors.dense([i for _, i in self.terms]), inputCol="_terms_counts", outputCol="_terms_weights").transform(out)
            parts[-1] = "_terms_weights"
            out = Normalizer(p=2.0, inputCol="_terms_weights", outputCol="_terms_unit").transform(out)
            parts[-1] = "_terms_unit"
        out = VectorAssembler(inputCols=parts, outputCol=output).transform(out)
        return out.select(*rows.columns, output)


def fit_model(train: DataFrame, features: Features, c: float = 1.0) -> LogisticRegressionModel:
    """Multinomial L2 regression with balanced classes, penalty 1 / c on the summed loss."""
    rows = features.assemble(class_weights(train)).select("features", F.col("label").cast("double"), "weight")
    n, path = train.count(), scratch(train.sparkSession, "train")
    # As in out_of_fold: equal rows are one row of their weight.
    same = rows.groupBy("features", "label", "weight").agg(F.count("*").alias("n"))
    same.select("features", "label", (F.col("weight") * F.col("n")).alias("weight")).write.parquet(path)
    rows = train.sparkSession.read.parquet(path)
    rows = rows.repartition(max(1, rows.count() // 20_000))  # every step of the solver is a job over them
    lr = LogisticRegression(family="multinomial", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=1000, tol=1e-10)
    return lr.fit(rows)


def predict(model: LogisticRegressionModel, rows: DataFrame, features: Features) -> DataFrame:
    scored = model.transform(features.assemble(rows))
    out = scored.withColumn("probability", vector_to_array("probability")).withColumn("rating", expected_rating(F.col("probability")))
    return out.select(*rows.columns, F.col("prediction").cast("int").alias("prediction"), "probability", "rating")


#: What stands for 1 in a fold's own intercept: so large that the penalty on it is nothing (a 10,000th of that on other features).
ONE = 100.0


def _blocks(rows: DataFrame, vocabularies: dict[str, list[tuple[int, str, float]]], folds: int, stop_words: Sequence[str]) -> DataFrame:
    """rows, each with a column `block`, with the features of that block's vocabulary at the block's own places, and its intercept's."""
    tag = lambda names: F.transform(names, lambda x: F.concat(F.col("block").cast("string"), F.lit("|"), x))
    whole = lambda c: F.array(F.coalesce(c, F.lit("unknown")))
    inputs = {"skill": F.coalesce("skills", F.array().cast("array<string>")), "seniority": whole("seniority"), "remote": whole("remote_policy"), "term": title_terms(F.col("title"), stop_words), "one": F.array(F.lit("1"))}
    out, parts = rows.withColumns({f"_{k}": tag(x) for k, x in inputs.items()}), []
    for kind in inputs:
        known = [(k, "1", ONE) for k in range(folds)] if kind == "one" else vocabularies.get(kind, [])
        if known:
            out = CountVectorizerModel.from_vocabulary([f"{k}|{t}" for k, t, _ in known], f"_{kind}", f"_{kind}_x").setBinary(kind != "term").transform(out)
            out = ElementwiseProduct(scalingVec=Vectors.dense([w for _, _, w in known]), inputCol=f"_{kind}_x", outputCol=f"_{kind}_w").transform(out)
            if kind == "term":
                out = Normalizer(p=2.0, inputCol="_term_w", outputCol="_term_u").transform(out)
            parts.append(f"_{kind}_{'u' if kind == 'term' else 'w'}")
    return VectorAssembler(inputCols=parts, outputCol="features").transform(out).select(*rows.columns, "features")


def out_of_fold(rows: DataFrame, folds: int = 5, stop_words: Sequence[str] | None = None, key: str = "vacancy_id", c: float = 1.0) -> DataFrame:
    """Every row scored by a model, and with a vocabulary, that never saw it: label, fold, prediction, probability and rating beside its columns.

    All folds are fitted at once: a row takes part in each fold but its own, at places that only this fold's model has, and a step of
    the solver is one job for all. With few features a fold (MOST_COEFFICIENTS) that is Newton's method, otherwise one L-BFGS fit over all
    places (the folds' losses and penalties share no number). The dealt rows are written once; vocabularies are collected, as the
    model's coefficients are.
    """
    spark, stop = rows.sparkSession, list(default_stop_words() if stop_words is None else stop_words)
    path = scratch(spark, "folds")
    assign_folds(rows, folds, key=key).write.parquet(path)
    dealt = spark.read.parquet(path)
    vocabularies: dict[str, list] = {}
    for r in fold_vocabularies(dealt, folds, stop, key).orderBy("kind", "without", "term").collect():
        vocabularies.setdefault(r.kind, []).append((r.without, r.term, r.idf))

    seen = dealt.withColumn("block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))))
    by = dealt.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()  # labels times folds
    of = {(label, k): sum(r.n for r in by if r.fold != k and r.label == label) for k in range(folds) for label in {r.label for r in by}}
    sizes = {k: sum(n for (_, block), n in of.items() if block == k) for k in range(folds)}
    weights = spark.createDataFrame([(label, k, sizes[k] / (3 * n)) for (label, k), n in of.items() if n], "label int, block int, weight double")
    train = _blocks(seen.join(F.broadcast(weights), ["label", "block"]), vocabularies, folds, stop)  # labels times folds
    n = sum(sizes.values())
    # Rows that a fold's model can't tell apart are one row of their weight: the loss is the same, and what a step reads grows with the
    # different rows only.
    path = scratch(spark, "train")
    same = train.select("block", "features", F.col("label").cast("int"), "weight").groupBy("block", "features", "label", "weight").agg(F.count("*").alias("n"))
    same.select("block", "features", "label", (F.col("weight") * F.col("n")).alias("weight")).write.parquet(path)
    train = spark.read.parquet(path)
    classes, places = 1 + max(label for label, _ in of if label is not None), _places(vocabularies, folds)
    scored = _blocks(dealt.withColumn("block", F.col("fold")), vocabularies, folds, stop)
    if classes * max(map(len, places.values())) <= MOST_COEFFICIENTS:
        penalty = sum(sizes[k] / 3 for (label, k), m in of.items() if m and label is not None) / (c * n)
        probability = _probability(newton(train, places, classes, penalty))(F.col("block"), *_sparse("features")).alias("probability")
        scored = scored.select(*dealt.columns, probability)
        best = F.array_position("probability", F.array_max("probability")) - 1
    else:
        train = train.repartition(max(1, train.count() // 20_000))  # every step is a job over them
        lr = LogisticRegression(family="multinomial", fitIntercept=False, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=1000, tol=1e-10)
        scored = lr.fit(train.withColumn("label", F.col("label").cast("double"))).transform(scored).withColumn("probability", vector_to_array("probability"))
        best = F.col("prediction")
    return scored.select(*dealt.columns, best.cast("int").alias("prediction"), "probability", expected_rating(F.col("probability")).alias("rating"))


#: Up to so many coefficients a fold is fitted by Newton's method, whose matrix has the square of that; beyond by L-BFGS.
MOST_COEFFICIENTS = 1200


def _places(vocabularies: dict[str, list[tuple[int, str, float]]], folds: int) -> dict[int, list[int]]:
    """Each block's own places in the features that _blocks gives, in order."""
    blocks = [b for kind in ("skill", "seniority", "remote", "term") for b, *_ in vocabularies.get(kind, [])] + list(range(folds))
    return {k: [i for i, b in enumerate(blocks) if b == k] for k in range(folds)}


def _sparse(column: str) -> tuple[Column, Column]:
    """Places and values of a vector, sparse or dense."""
    v = F.unwrap_udt(column)
    return F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1)), v["values"]


def _matrix(places: list[int], at, values) -> np.ndarray:
    """Rows (lists of places and values) as a matrix over a block's places."""
    x = np.zeros((len(at), len(places)))
    if len(at):
        row = np.repeat(np.arange(len(at)), [len(v) for v in values])
        x[row, np.searchsorted(places, np.concatenate(list(at)).astype(int))] = np.concatenate(list(values))
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _derivatives(x: np.ndarray, label: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of the rows, in one array."""
    (classes, d), p = theta.shape, _softmax(x @ theta.T)
    z = x @ theta.T
    top = z.max(axis=1)
    loss = (weight * (top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - z[np.arange(len(x)), label])).sum()
    gradient = ((p - np.eye(classes)[label]) * weight[:, None]).T @ x
    hessian = np.empty((classes, d, classes, d))
    for a in range(classes):
        for b in range(a + 1):
            hessian[a, :, b, :] = (x * (weight * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
            hessian[b, :, a, :] = hessian[a, :, b, :]
    return np.concatenate([[loss], gradient.ravel(), hessian.ravel()])


def newton(train: DataFrame, places: dict[int, list[int]], classes: int, penalty: float, most: int = 200) -> dict[int, tuple[list[int], np.ndarray]]:
    """The coefficients (a row a class) of each block of train (block, features, label, weight), with its places. They have the least
    weighted loss plus penalty / 2 of their squares.

    A step is one job for all blocks: tasks add up their rows' gradients and Hessians, one task a block those of the tasks. Their number doesn't
    depend on how many rows there are, as that of L-BFGS steps does (the more rows, the less the penalty holds what they leave open)."""
    theta = {k: np.zeros((classes, len(at))) for k, at in places.items()}
    rows, state, going = train.select("block", *(x.alias(n) for n, x in zip(("at", "value"), _sparse("features"), strict=True)), "label", "weight"), {}, set(places)
    for _ in range(most):
        now = {k: theta[k] for k in going}

        def part(frames, now=now):
            sums: dict = {}
            for f in frames:
                for k, g in f.groupby("block"):
                    here = _derivatives(_matrix(places[k], g["at"], g["value"]), g["label"].to_numpy(), g["weight"].to_numpy(), now[k])
                    sums[k] = sums[k] + here if k in sums else here
            yield pd.DataFrame({"block": list(sums), "sums": [x.tobytes() for x in sums.values()]})

        def whole(f):
            total = np.sum([np.frombuffer(x) for x in f["sums"]], axis=0)
            return pd.DataFrame({"block": [f["block"].iloc[0]], "sums": [total.tobytes()]})

        schema = "block int, sums binary"
        sums = {r.block: np.frombuffer(bytes(r.sums)) for r in rows.where(F.col("block").isin(*going)).mapInPandas(part, schema).groupBy("block").applyInPandas(whole, schema).collect()}
        for k in sorted(going):
            size = theta[k].size
            total = sums.get(k, np.zeros(1 + size + size * size))  # no rows: the penalty alone
            flat = theta[k].ravel()
            loss = total[0] + penalty / 2 * flat @ flat
            if k in state and not loss <= state[k][1] * (1 + 1e-9) + 1e-9:  # too far: half the way
                start, before, step = state[k]
                state[k] = start, before, step / 2
            else:
                gradient = total[1 : 1 + size] + penalty * flat
                hessian = total[1 + size :].reshape(size, size) + penalty * np.eye(size)
                scale = 1 / np.sqrt(np.diag(hessian))
                step = -scale * np.linalg.solve(hessian * scale[:, None] * scale, scale * gradient)
                state[k] = flat, loss, step
                if -gradient @ step <= 1e-12:  # twice what is left to gain
                    going.discard(k)
            theta[k] = (state[k][0] + state[k][2]).reshape(theta[k].shape)
        if not going:
            return {k: (places[k], theta[k]) for k in places}
    raise RuntimeError(f"no end after {most} steps")


def _probability(fitted: dict[int, tuple[list[int], np.ndarray]]):
    """block and its features (places, values) to the classes' probabilities."""

    @F.pandas_udf("array<double>")
    def probability(block: pd.Series, at: pd.Series, values: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(block), index=block.index, dtype=object)
        for k, index in block.groupby(block).groups.items():
            places, theta = fitted[k]
            out[index] = list(_softmax(_matrix(places, at[index], values[index]) @ theta.T))
        return out

    return probability


def coefficient_axis(model: LogisticRegressionModel, features: Features, ends: int = 10) -> DataFrame:
    """feature, axis (coefficient of label 2 less that of label 0): the lowest and the highest."""
    from pyspark.sql import SparkSession

    m = model.coefficientMatrix.toArray()
    rows = [(n, float(v)) for n, v in zip(features.names(), m[2] - m[0], strict=True)]
    df = SparkSession.getActiveSession().createDataFrame(rows, "feature string, axis double")
    return df.orderBy("axis", "feature").limit(ends).unionByName(df.orderBy(F.col("axis").desc(), "feature").limit(ends)).distinct()
