import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from jobweave.operators import model, ranking

ROWS = "vacancy_id long, label int, title string, skills array<string>, seniority string, remote_policy string"


def labelled(spark, n=90, seed=0):
    rng = random.Random(seed)
    titles = ["Data Engineer", "ML Scientist", "Platform Engineer data", "Data data Scientist", None, ""]
    rows = []
    for i in range(n):
        label = rng.choice([0, 0, 1, 2])
        skills = rng.sample(["Python", "Go", "SQL", "Rust", f"rare{i}"], rng.randrange(0, 4)) + ["Spark"] * (label == 2) * 2
        rows.append((i, label, rng.choice(titles), skills or None, rng.choice(["junior", "mid", None]), rng.choice(["remote", "hybrid"])))
    return spark.createDataFrame(rows, ROWS)


def one_by_one(rows, folds, stop):
    """The folds' models fitted one after the other, each with a vocabulary of its own."""
    dealt = ranking.assign_folds(rows, folds)
    out = {}
    for k in range(folds):
        train, test = dealt.where(F.col("fold") != k), dealt.where(F.col("fold") == k)
        features = model.Features.fit(train, stop)
        for r in model.predict(model.fit_model(train, features), test, features).collect():
            out[r.vacancy_id] = (k, r.prediction, np.array(r.probability), r.rating)
    return out


def test_all_folds_at_once_equal_one_by_one(spark):
    rows = labelled(spark)
    expected = one_by_one(rows, 3, ["data"])
    got = model.out_of_fold(rows, 3, ["data"]).collect()
    assert len(got) == len(expected)
    for r in got:
        fold, prediction, probability, rating = expected[r.vacancy_id]
        assert (r.fold, r.prediction) == (fold, prediction)
        assert np.abs(np.array(r.probability) - probability).max() < 2e-5 and abs(r.rating - rating) < 2e-5


def test_steps_and_what_they_read_do_not_grow_with_the_rows(spark):
    copies = labelled(spark).crossJoin(spark.range(20).select((F.col("id") * 1000).alias("more"))).withColumn("vacancy_id", F.col("vacancy_id") + F.col("more")).drop("more")
    spark.sparkContext.setJobGroup("fold fit", "")
    try:
        assert model.out_of_fold(copies, 3, ["data"]).count() == 1800
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fold fit"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 100  # L-BFGS takes hundreds of steps, each a job


def test_folds_of_many_features_are_fitted_alike(spark, monkeypatch):
    rows = labelled(spark)
    few = {r.vacancy_id: r for r in model.out_of_fold(rows, 3, ["data"]).collect()}
    monkeypatch.setattr(model, "MOST_COEFFICIENTS", 0)
    many = model.out_of_fold(rows, 3, ["data"]).collect()
    assert len(many) == len(few) == 90
    for r in many:
        assert (r.fold, r.prediction) == (few[r.vacancy_id].fold, few[r.vacancy_id].prediction) and abs(r.rating - few[r.vacancy_id].rating) < 2e-5


def test_newton_ends_at_the_least_loss(spark):
    rng, rows = np.random.default_rng(1), []
    for _ in range(300):
        block, x = int(rng.integers(2)), np.round(rng.normal(size=3), 1)
        label = int(rng.integers(3 if block else 2))  # block 0 never sees label 2, block 2 no row at all
        # Even places are block 1's; a feature is large, as the intercept's is.
        rows.append((block, Vectors.sparse(7, [(2 * i + 1 - block, float(v) * (100 if i == 2 else 1)) for i, v in enumerate(x) if v]), label, float(rng.integers(1, 9))))
    places = {0: [1, 3, 5], 1: [0, 2, 4], 2: [6]}
    schema = StructType([StructField("block", IntegerType()), StructField("features", VectorUDT()), StructField("label", IntegerType()), StructField("weight", DoubleType())])
    fitted = model.newton(spark.createDataFrame(rows, schema), places, 3, 1.0)
    for k, (at, theta) in fitted.items():
        gradient = theta.copy()
        for block, v, label, weight in rows:
            if block == k:
                x = v.toArray()[at]
                e = np.exp(theta @ x - (theta @ x).max())
                gradient += weight * np.outer(e / e.sum() - np.eye(3)[label], x)
        assert at == places[k] and np.abs(gradient).max() < 1e-5, k


def test_a_fold_knows_nothing_of_its_own_rows(spark):
    rows = labelled(spark, 30)
    odd = spark.createDataFrame([(1000, 2, "Zebra Keeper", ["Zoo"] * 5, "zoo", "zoo")], ROWS)
    dealt = ranking.assign_folds(rows.unionByName(odd), 3)
    home = dealt.where("vacancy_id = 1000").first().fold
    known = {(r.without, r.kind, r.term) for r in model.fold_vocabularies(dealt, 3, []).collect()}
    for k in range(3):
        for kind, term in (("skill", "Zoo"), ("seniority", "zoo"), ("term", "zebra keeper")):
            assert ((k, kind, term) in known) == (k != home)


@pytest.mark.parametrize("most", [150, 4])
def test_fold_vocabularies(spark, most):
    rows = labelled(spark, 60, seed=3)
    dealt = ranking.assign_folds(rows, 4)
    got = {}
    for r in model.fold_vocabularies(dealt, 4, ["data"], most=most).collect():
        got.setdefault((r.without, r.kind), {})[r.term] = round(r.idf, 9)
    for k in range(4):
        train = [r for r in dealt.collect() if r.fold != k]
        skills = Counter(s for r in train for s in r.skills or [])
        assert got[k, "skill"] == {s: 1.0 for s, n in skills.items() if n >= 3}
        assert set(got[k, "seniority"]) == {r.seniority or "unknown" for r in train}
        count, df = Counter(), Counter()
        for r in train:
            w = [x for x in (r.title or "").lower().split() if x != "data" and len(x) > 1]
            terms = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
            count.update(terms)
            df.update(set(terms))
        best = sorted(count, key=lambda t: (-count[t], t))[:most]
        assert got[k, "term"] == {t: round(math.log((1 + len(train)) / (1 + df[t])) + 1, 9) for t in best}


def test_ordinals(spark):
    rng = random.Random(2)
    values = [f"s{rng.randrange(500)}" for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "skill string").repartition(5)
    expected = {s: i for i, s in enumerate(sorted(set(values)))}
    for parts in (1, 3, 40):
        assert {r.skill: r.ordinal for r in model.ordinals(df, "skill", parts).collect()} == expected
    assert model.ordinals(df.where("false"), "skill").collect() == []
    some = model.ordinals(spark.createDataFrame([("b",), (None,), ("a",)], "skill string"), "skill")
    assert {r.skill: r.ordinal for r in some.collect()} == {None: 0, "a": 1, "b": 2}


def test_ordinals_of_many_values(spark):
    n = 1_000_000
    out = model.ordinals(spark.range(n).select(F.format_string("%09d", F.col("id")).alias("skill")), "skill", 16)
    assert out.agg(F.min(F.col("ordinal") == F.col("skill").cast("long")), F.count("*")).first()[:] == (True, n)


def test_multi_hot(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "a"]), (2, ["b"]), (3, ["b", "c"]), (4, []), (5, None), (6, ["a", "x"])], "k int, s array<string>")
    assert sorted(tuple(r) for r in model.multi_hot(rows, "k", "s").collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 1, "b"), (3, 1, "b"), (6, 0, "a")]
