import pytest
from pyspark.sql import functions as F

from jobweave.operators import state
from jobweave.operators.store import POSTINGS, SEEN, ConcurrentCommit, Relation, Store, merge_postings, merge_seen

ROW = "source string, url string, title string, company string, location string, raw_text string, ordinal int"
MARK = "source string, external_id string, accepted boolean, ordinal int"


def day(n):
    return F.lit(f"2024-01-{n:02d}").cast("timestamp")


def batch(spark, keys, tag):
    return spark.createDataFrame([("s", f"u{k}", f"{tag}{k}", None, "l", "r", 1) for k in keys], ROW)


def marks(spark, keys, accepted):
    return spark.createDataFrame([("s", f"u{k}", accepted, 1) for k in keys], MARK).withColumn("seen_at", day(1))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", {"postings": Relation(POSTINGS.key, POSTINGS.schema, 32), "seen": Relation(SEEN.key, SEEN.schema, 8)})


def content(store):
    return sorted(map(tuple, store.read("postings").collect())), sorted(map(tuple, store.read("seen").collect()))


def test_equals_the_upsert_of_whole_relations(spark, store):
    assert content(store) == ([], [])
    whole = spark.createDataFrame([], POSTINGS.schema)
    for n, keys in enumerate((range(40), range(30, 60), [5], []), 1):
        rows = batch(spark, keys, f"t{n}-")
        rows = rows.unionByName(rows.withColumns({"title": F.concat("title", F.lit("+")), "ordinal": F.lit(2)}))  # the later row of a key counts
        store.merge({"postings": (rows, merge_postings(day(n)))})
        whole = state.upsert_postings(whole, rows, day(n)).select(*whole.columns)
        whole = spark.createDataFrame(whole.collect(), whole.schema)
        assert content(store)[0] == sorted(map(tuple, whole.collect()))


def test_only_touched_buckets_are_rewritten(spark, store):
    store.merge({"postings": (batch(spark, range(400), "a"), merge_postings(day(1)))})
    before = store.manifest()["relations"]["postings"]
    few = batch(spark, [3, 9, 400], "b")
    touched = {str(r.b) for r in few.select(store.bucket("postings").alias("b")).collect()}
    assert store.merge({"postings": (few, merge_postings(day(2)))}) == {"postings": len(touched)}
    after = store.manifest()["relations"]["postings"]
    assert len(touched) < 4 and len(before) == 32 and {b for b in after if after[b] != before.get(b)} == touched
    assert store.read("postings").count() == 401


def test_one_shuffle_of_the_old_rows(spark, store):
    store.merge({"postings": (batch(spark, range(50), "a"), merge_postings(day(1)))})
    new = batch(spark, range(9), "b").withColumn("bucket", store.bucket("postings"))
    plan = merge_postings(day(2))(store._buckets("postings", store.manifest()["relations"]["postings"], range(32)), new)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Union")[0]
    assert below.count("Exchange") == 1, plan


def test_first_evaluation_wins(spark, store):
    store.merge({"seen": (marks(spark, [1, 2], False), merge_seen())})
    store.merge({"seen": (marks(spark, [2, 3], True), merge_seen())})
    assert [(r[1], r[2]) for r in content(store)[1]] == [("u1", False), ("u2", False), ("u3", True)]


def changes(spark, n, keys):
    return {"postings": (batch(spark, keys, f"t{n}-"), merge_postings(day(n))), "seen": (marks(spark, keys, True), merge_seen())}


@pytest.mark.parametrize("step", ["postings", "seen", "manifest", "commit", "clean"])
def test_a_crash_leaves_one_state_of_both_relations(spark, store, monkeypatch, step):
    store.merge(changes(spark, 1, range(6)))
    before = content(store)

    class Crash(Exception):
        pass

    def crash(*_, **__):
        raise Crash

    with monkeypatch.context() as m:
        if step in ("postings", "seen"):
            real, seen = store._names, []
            m.setattr(store, "_names", lambda path: crash() if f"/{step}/v=" in path else real(path))
        elif step == "manifest":
            m.setattr(store, "_create", crash)
        elif step == "commit":  # the file of the commit is there, but empty
            real = store._create
            m.setattr(store, "_create", lambda path, text: (real(path, ""), crash()) if "/_commits/" in path else real(path, text))
        else:
            m.setattr(store, "_clean", crash)
        with pytest.raises(Crash):
            store.merge(changes(spark, 2, range(4, 9)))
    after = content(store)
    if step == "clean":
        assert len(after[0]) == 9 and len(after[1]) == 9
    else:
        assert after == before
    store.merge(changes(spark, 3, range(4, 9)))
    postings, seen = content(store)
    assert len(postings) == 9 and len(seen) == 9 and {r[3] for r in postings} == {f"t1-{k}" for k in range(4)} | {f"t3-{k}" for k in range(4, 9)}
    store.merge(changes(spark, 4, [0]))
    used = {v for c in store._commits() for held in store._manifest(c[1])["relations"].values() for v in held.values()}
    assert {x.removeprefix("v=") for n in ("postings", "seen") for x in store._names(f"{store.path}/{n}")} == used  # nothing is left behind


def test_of_two_writers_one_fails(spark, store, monkeypatch):
    store.merge(changes(spark, 1, range(3)))
    other = Store(spark, store.path, store.relations)
    real = store._commit
    monkeypatch.setattr(store, "_commit", lambda *a: (other.merge(changes(spark, 2, [7])), real(*a)))
    with pytest.raises(ConcurrentCommit):
        store.merge(changes(spark, 3, [8]))
    assert {r[2] for r in content(store)[0]} == {"u0", "u1", "u2", "u7"}


def test_a_replayed_batch_does_nothing(spark, store):
    assert store.merge(changes(spark, 1, [1]), stream="a", batch=4)["seen"] == 1
    assert store.merge(changes(spark, 2, [2]), stream="a", batch=4) == {"postings": 0, "seen": 0}
    assert store.merge(changes(spark, 3, [3]), stream="b", batch=0)["seen"] == 1
    assert [r[1] for r in content(store)[1]] == ["u1", "u3"]
