import hashlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobweave.operators import model, ranking, state

COLUMNS = "source string, url string, title string, company string, location string, raw_text string, ordinal int"
TARGET = "id long, source string, url string, title string, company string, location string, raw_text string, scraped_at timestamp, first_seen timestamp, last_seen timestamp"


def test_upsert_keeps_first_seen(spark):
    day = lambda d: F.lit(f"2024-01-0{d}").cast("timestamp")
    rows = lambda *r: spark.createDataFrame([("s", u, t, None, None, t, i) for i, (u, t) in enumerate(r)], COLUMNS)
    first = state.upsert_postings(spark.createDataFrame([], TARGET), rows(("u", "old"), ("v", "x")), day(1))
    second = state.upsert_postings(first, rows(("u", "mid"), ("u", "new")), day(2))
    out = {r.url: r for r in second.collect()}
    assert len(out) == 2 and out["u"].title == "new" and out["v"].title == "x"
    assert (out["u"].first_seen.day, out["u"].last_seen.day, out["v"].last_seen.day) == (1, 2, 1)
    again = state.upsert_postings(second, rows(("u", "mid"), ("u", "new")), day(2))
    assert sorted(again.collect()) == sorted(second.collect())


def test_seen_and_labels(spark):
    s = spark.createDataFrame([("a", "1", True)], "source string, external_id string, accepted boolean")
    new = spark.createDataFrame([("a", "1", False, 0), ("a", "2", False, 1), ("a", "2", True, 2)], "source string, external_id string, accepted boolean, ordinal int")
    assert sorted((r.external_id, r.accepted) for r in state.mark_seen(s, new).collect()) == [("1", True), ("2", False)]
    labels = spark.createDataFrame([(1, 2)], "vacancy_id long, label int")
    assert state.insert_labels(labels, spark.createDataFrame([(2, 0)], labels.schema)).count() == 2
    for bad in ((1, 0), (3, 5), (3, None)):
        with pytest.raises(Exception, match="bad or repeated label"):
            state.insert_labels(labels, spark.createDataFrame([bad], labels.schema)).collect()


def test_publish(spark, tmp_path):
    path, schema = str(tmp_path / "t"), spark.range(1).schema
    assert state.read_published(spark, path, schema).count() == 0
    for n in range(1, 5):
        state.publish(spark.range(n), path)
        assert state.read_published(spark, path, schema).count() == n
    assert len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("version-")]) == 2


@pytest.mark.parametrize("step", ["write", "create", "delete"])
def test_publish_survives_a_crash_at_each_step(spark, tmp_path, monkeypatch, step):
    path, schema = str(tmp_path / "t"), spark.range(1).schema
    for n in (4, 5):
        state.publish(spark.range(n), path)
    files = state._files

    class Crash(Exception):
        pass

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == step:
                raise Crash
            return getattr(self.fs, name)

    def half(at):
        spark.range(3).write.parquet(at)
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(state, "_files", lambda s, p: (Broken(files(s, p)[0]), files(s, p)[1]))
        df = SimpleNamespace(sparkSession=spark, write=SimpleNamespace(parquet=half)) if step == "write" else spark.range(6)
        with pytest.raises(Crash):
            state.publish(df, path)
    known = 6 if step == "delete" else 5
    assert state.read_published(spark, path, schema).count() == known
    state.publish(state.read_published(spark, path, schema).unionByName(spark.range(1)), path)
    assert state.read_published(spark, path, schema).count() == known + 1


def test_precision_ties_and_short_lists(spark):
    rows = spark.createDataFrame([("m", 1.0, i, 2 if i < 3 else 0) for i in range(7)], "method string, score double, tie int, label int")
    assert {r.k: r.precision for r in ranking.precision_at_k(rows).collect()} == {5: 0.6}


def test_cosine(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0])], "i int, embedding array<float>")
    out = [r.cosine for r in ranking.against_profile(df, df.where("i = 0")).orderBy("i").collect()]
    assert out[0] == 1 and np.isnan(out[1]) and abs(out[2] - 2**-0.5) < 1e-9


def test_folds(spark):
    labels = spark.createDataFrame([(i, i % 3) for i in range(31)], "vacancy_id long, label int")
    n = {}
    for r in ranking.assign_folds(labels).collect():
        n[r.label, r.fold] = n.get((r.label, r.fold), 0) + 1
    for label in range(3):
        sizes = [n.get((label, f), 0) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_folds_agree_with_one_ranking_per_label(spark):
    rows = [(i, (0, 1, 2, None)[0 if i % 3 else i % 4]) for i in range(3000)] + [(None, 1), (7, 0), (7, 0)]
    got = ranking.assign_folds(spark.createDataFrame(rows, "vacancy_id int, label int"), folds=7, seed=3).collect()
    want = []
    for label in (0, 1, 2, None):
        ids = sorted((x for x, y in rows if y == label), key=lambda x: ("", -1) if x is None else (hashlib.md5(f"3:{x}".encode()).hexdigest(), x))
        want += [(x, label, place % 7) for place, x in enumerate(ids)]
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def solve(x, y, w):
    c, b = np.zeros((3, x.shape[1])), np.zeros(3)
    for _ in range(20000):
        z = x @ c.T + b
        p = np.exp(z - z.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - np.eye(3)[y]) * w[:, None]
        c -= 0.01 * (p.T @ x + c)
        b -= 0.01 * p.sum(0)
    return c, b


def test_out_of_fold(spark):
    """Each row's rating is that of a model of the other folds' rows, with their vocabulary: in numpy, fold by fold."""
    rng = np.random.default_rng(3)
    titles = ["Data Engineer", "ML Scientist", "Backend Developer"]
    rows = [(i, int(rng.integers(0, 3)), titles[int(rng.integers(0, 3))], [["Python", "Go", "SQL"][int(k)] for k in rng.integers(0, 3, 2)] + ([f"only{i}"] * 3 if i % 7 == 0 else []), "junior", None) for i in range(50)]
    df = spark.createDataFrame(rows, "vacancy_id long, label int, title string, skills array<string>, seniority string, remote_policy string")
    got = {r.vacancy_id: (r.fold, r.rating) for r in model.out_of_fold(df, 3).collect()}
    assert len(got) == 50
    for k in range(3):
        train = [r for r in rows if got[r[0]][0] != k]
        test = [r for r in rows if got[r[0]][0] == k]
        fitted = model.Features.fit(spark.createDataFrame(train, df.schema))
        assert not {f"skill:only{r[0]}" for r in test} & set(fitted.names())
        x, z = (np.array([v.features.toArray() for v in fitted.assemble(spark.createDataFrame(part, df.schema)).orderBy("vacancy_id").collect()]) for part in (train, test))
        y = np.array([r[1] for r in train])
        c, b = solve(x, y, (len(y) / 3 / np.bincount(y, minlength=3))[y])
        p = np.exp(z @ c.T + b)
        rating = (p / p.sum(1, keepdims=True)) @ [0, 1, 2]
        assert np.abs(rating - [got[r[0]][1] for r in test]).max() < 1e-3


def test_coefficient_axis_spread_and_order(spark):
    features = model.Features(skills=[f"s{i:02d}" for i in range(30)])
    matrix = np.zeros((3, 30))
    matrix[2] = np.arange(30)
    fake = SimpleNamespace(coefficientMatrix=SimpleNamespace(toArray=lambda: matrix))
    got = {r.feature: r.axis for r in model.coefficient_axis(fake, features, 3).collect()}
    assert got == {f"skill:s{i:02d}": float(i) for i in (0, 1, 2, 27, 28, 29)}
    scores = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 7.0), (4, None)], "id long, s double")
    assert ranking.score_spread(scores, "s").first()[:] == (5.0, 7.0, 19 / 3, 2, 3)
    order = [r.id for r in ranking.shuffled(scores, "id").collect()]
    assert sorted(order) == [1, 2, 3, 4] and order == [r.id for r in ranking.shuffled(scores.repartition(3), "id").collect()]
    weights = {r.label: r.weight for r in ranking.class_weights(spark.createDataFrame([(i, int(i > 2)) for i in range(9)], "vacancy_id long, label int")).collect()}
    assert weights == {0: 1.0, 1: 0.5}


def test_first_seen(spark, tmp_path):
    from jobweave.streaming.incremental import first_seen

    kind = "source string, external_id string, seen_at timestamp"
    spark.sql("SELECT 's' AS source, CAST(id % 3 AS STRING) AS external_id, TIMESTAMP '2024-01-01' AS seen_at FROM range(9)").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = first_seen(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.external_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["0", "1", "2"]


def test_model_matches_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(rng.integers(0, 3)), "Data Engineer" if rng.random() < 0.5 else "ML Scientist", [["Python", "Go", "SQL"][int(k)] for k in rng.integers(0, 3, 2)], "junior", "remote") for i in range(60)]
    df = spark.createDataFrame(rows, "vacancy_id long, label int, title string, skills array<string>, seniority string, remote_policy string")
    features = model.Features.fit(df)
    x = np.array([r.features.toArray() for r in features.assemble(df).orderBy("vacancy_id").collect()])
    y = np.array([r[1] for r in rows])
    fitted = model.fit_model(df, features)
    w = (len(y) / 3 / np.bincount(y, minlength=3))[y]
    c, b = solve(x, y, w)
    assert np.abs(fitted.coefficientMatrix.toArray() - c).max() < 1e-4
    out = model.predict(fitted, df, features)
    assert out.where("rating < 0 OR rating > 2").count() == 0
