"""Ranking of labelled postings: cosine similarity, top-k, precision@k, score spread, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (5, 10, 20)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """dot / (|a| |b|); NaN if either norm is zero."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm == 0, F.lit(float("nan"))).otherwise(_dot(a, b) / F.nullif(norm, F.lit(0.0)))


def against_profile(rows: DataFrame, profile: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows with the cosine similarity to the profile's one vector, which is a scalar subquery: each task gets it as a constant."""
    return rows.withColumn("_profile", profile.select(vector).scalar()).withColumn("cosine", cosine(F.col(vector), F.col("_profile"))).drop("_profile")


def top_k(scored: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows, the best first; equal scores by the tie column."""
    return scored.orderBy(F.col(score).desc(), F.col(tie)).limit(k)


def precision_at_k(scored: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """scored: method, score, tie, label. Gives method, k, precision: the share of label 2 among a method's k best rows, for
    each k that it has rows for. Only the best max(ks) rows of a method are ranked: each partition keeps its own first."""
    most = max(ks)
    place = Window.partitionBy("method").orderBy(F.col("score").desc(), F.col("tie"))
    ranked = scored.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)
    at = ranked.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("place <= k")
    return at.groupBy("method", "k").agg(F.avg((F.col("label") == 2).cast("double")).alias("precision"), F.count("*").alias("n")).where("n = k").select("method", "k", "precision")


def benchmark(rows: DataFrame, scores: Sequence[str], tie: str = "vacancy_id") -> DataFrame:
    """The same rows ranked by each of several score columns."""
    long = rows.unpivot([tie, "label"], list(scores), "method", "score")
    return precision_at_k(long.withColumnRenamed(tie, "tie"))


def score_spread(scored: DataFrame, score: str) -> DataFrame:
    return scored.agg(F.min(score).alias("low"), F.max(score).alias("high"), F.avg(score).alias("mean"), F.countDistinct(score).alias("n_unique"), F.count(score).alias("n"))


def class_weights(labels: DataFrame) -> DataFrame:
    """Adds weight: n / (3 * rows of the label)."""
    n = labels.groupBy("label").count().withColumn("total", F.sum("count").over(Window.partitionBy(F.lit(1))))
    return labels.join(F.broadcast(n), "label").withColumn("weight", F.col("total") / (3 * F.col("count"))).drop("count", "total")


def assign_folds(labels: DataFrame, folds: int = 5, seed: int = 42, key: str = "vacancy_id") -> DataFrame:
    """Stratified folds: within a label, rows are dealt out in the order of md5('seed:id'). Class sizes differ by one at most.

    A label may hold most rows, so it is ranked in ranges of its md5 values; a range's rows come after those of the ranges before it.
    Null labels are a class of their own; null ids come first.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    ranged = labels.withColumn("_digest", digest).withColumn("_range", F.coalesce(F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int"), F.lit(-1)))
    before = Window.partitionBy("_label").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(F.col("label").alias("_label"), F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    # At most 4097 rows a label.
    starts = counts.select("_label", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("label", "_range").orderBy("_digest", key)) - 1
    dealt = ranged.withColumn("_place", place).join(starts, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_of")))
    return dealt.withColumn("fold", ((F.col("_start") + F.col("_place")) % folds).cast("int")).select(*labels.columns, "fold")


def metrics(predicted: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """predicted: label, prediction. Precision, recall and F1 of the classes 0, 1, 2 and accuracy; 0 where undefined."""
    aggs = [F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy")]
    for c in (0, 1, 2):
        hit = F.sum(((F.col("label") == c) & (F.col("prediction") == c)).cast("double"))
        p = F.coalesce(F.try_divide(hit, F.sum((F.col("prediction") == c).cast("double"))), F.lit(0.0))
        r = F.coalesce(F.try_divide(hit, F.sum((F.col("label") == c).cast("double"))), F.lit(0.0))
        aggs += [p.alias(f"precision_{c}"), r.alias(f"recall_{c}"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias(f"f1_{c}")]
    return predicted.groupBy(*by).agg(*aggs)


def over_folds(per_fold: DataFrame) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    names = [c for c in per_fold.columns if c != "fold"]
    return per_fold.agg(*(f(c).alias(f"{c}_{n}") for c in names for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))))


def label_counts(labels: DataFrame) -> DataFrame:
    """Rows of each of the labels 0, 1, 2; 0 for those that are missing."""
    every = labels.sparkSession.range(3).select(F.col("id").cast("int").alias("label"))
    return every.join(labels.groupBy("label").count(), "label", "left").select("label", F.coalesce("count", F.lit(0)).alias("n"))


def label_shares(labels: DataFrame) -> DataFrame:
    """Share of all rows that each label present has."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.select("label", (F.col("n") / total.scalar()).alias("share"))


def expected_rating(p: Column) -> Column:
    return F.get(p, F.lit(1)) + 2 * F.get(p, F.lit(2))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A repeatable random order."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)


def round_robin(ordinal: Column, n: int) -> Column:
    """Slot of the call with that ordinal number, dealt out in turn over n keys."""
    return F.pmod(ordinal, F.lit(n)).cast("int")
