import datetime
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobweave.operators.store import POSTINGS, SEEN, Relation, Store
from jobweave.streaming import incremental
from jobweave.streaming.incremental import MARK, first_evaluations, store_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, ROCKS)
    yield spark
    spark.conf.unset(PROVIDER)


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def land(spark, path, *rows):
    spark.createDataFrame(list(rows), MARK).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, seen):
    out = first_evaluations(spark.readStream.schema(MARK).parquet(str(tmp_path / "in")), seen)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r.external_id, r.accepted, r.seen_at) for r in spark.read.schema(MARK).parquet(str(tmp_path / "out")).collect())


def test_first_evaluations_are_never_forgotten(rocks, tmp_path):
    seen = rocks.createDataFrame([("s", "old", True, at(1))], MARK)
    land(rocks, str(tmp_path / "in"), ("s", "a", False, at(2, 5)), ("s", "a", True, at(2, 3)), ("s", "b", True, at(2)), ("s", "old", False, at(2)), ("s", None, True, at(2)), (None, "a", True, at(2)), ("s", "t", True, at(2)), ("s", "t", None, at(2)))
    first = run(rocks, tmp_path, seen)
    assert first == [("a", True, at(2, 3)), ("b", True, at(2)), ("t", False, at(2))]
    # A restart, and repeats long after: one with an older time, one years later; a key that is new.
    land(rocks, str(tmp_path / "in"), ("s", "a", False, at(1)), ("s", "b", False, datetime.datetime(2031, 1, 1)), ("s", "old", True, at(9)), ("z", "a", True, at(9)))
    assert run(rocks, tmp_path, seen) == sorted([*first, ("a", True, at(9))])


def test_the_state_is_asked_by_bucket(rocks, tmp_path):
    n, source, out = 9000, str(tmp_path / "in"), str(tmp_path / "out")
    rocks.range(n).selectExpr("'s' AS source", "cast(id AS string) AS external_id", "true AS accepted", "timestamp'2024-01-01' AS seen_at").write.parquet(source)
    seen = rocks.range(0, n, 2).selectExpr("'s' AS source", "cast(id AS string) AS external_id", "true AS accepted", "timestamp'2023-01-01' AS seen_at")
    query = first_evaluations(rocks.readStream.schema(MARK).parquet(source), seen).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = rocks.read.schema(MARK).parquet(out)
    assert got.count() == got.select("external_id").distinct().count() == n / 2 and got.where("external_id % 2 = 0").isEmpty()
    # At most an entry for what was seen before and one for the batch (and one in which RocksDB may count a list): not one a key.
    held = max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators)
    assert 0 < held <= 2 * incremental.BUCKETS


def test_many_entries_of_a_bucket_become_one(monkeypatch):
    class Kept(list):
        get, appendList, put = list.copy, list.extend, lambda self, new: self.__setitem__(slice(None), new)

    monkeypatch.setattr(incremental, "MOST_ENTRIES", 3)
    first, kept = incremental._First(), Kept()
    first.init(SimpleNamespace(getListState=lambda *_: kept))
    frame = lambda *names: pd.DataFrame([("s", x, True, pd.Timestamp(2024, 1, 1)) for x in names], columns=["source", "external_id", "accepted", "seen_at"])
    first.handleInitialState((0,), frame("k0"), None)
    for i in range(1, 20):
        (new,) = first.handleInputRows((0,), iter([frame(f"k{i}", "k0"), frame(f"k{i - 1}")]), None)
        assert new.external_id.tolist() == [f"k{i}"] and len(kept) <= 3
    assert sorted(x for e in kept for x in e[1]) == sorted(f"k{i}" for i in range(20))
    assert list(first.handleInputRows((0,), iter([frame("k3")]), None)) == [] and list(first.handleInputRows((0,), iter([]), None)) == []


def test_a_store_that_forgets_is_refused(spark, tmp_path):
    land(spark, str(tmp_path / "in"), ("s", "a", True, at(1)))
    with pytest.raises(ValueError, match="RocksDB"):
        first_evaluations(spark.readStream.schema(MARK).parquet(str(tmp_path / "in")), spark.createDataFrame([], MARK))


def test_stream_into_the_store(spark, tmp_path, monkeypatch):
    rows = "source string, url string, title string, company string, location string, raw_text string, ordinal int"
    store = Store(spark, f"file://{tmp_path}/store", {"postings": Relation(POSTINGS.key, POSTINGS.schema, 16), "seen": SEEN})
    source, check = str(tmp_path / "in"), str(tmp_path / "check")

    def arrive(*rows_):
        spark.createDataFrame(list(rows_), rows).coalesce(1).write.mode("append").parquet(source)

    def go():
        store_stream(spark.readStream.schema(rows).parquet(source), store, check, "postings").awaitTermination()
        return sorted((r.url, r.title) for r in store.read("postings").collect())

    arrive(("s", "u", "t", None, None, "x", 1), ("s", "u", "t2", None, None, "x", 2), ("s", "v", "t", None, None, "x", 1))
    assert go() == [("u", "t2"), ("v", "t")]
    arrive(("s", "u", "t3", None, None, "x", 1))
    # The driver dies after the commit and before Spark notes the batch: the batch comes again, and changes nothing.
    with monkeypatch.context() as m:
        real = store.merge
        m.setattr(store, "merge", lambda *a, **k: (real(*a, **k), 1 / 0))
        with pytest.raises(Exception, match="ZeroDivision"):
            go()
    before = store.manifest()
    assert go() == [("u", "t3"), ("v", "t")] and store.manifest() == before
    first = store.read("postings").agg(F.min("first_seen") < F.max("last_seen")).first()[0]
    assert first


def test_stream_of_marks(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", {"seen": Relation(SEEN.key, SEEN.schema, 4)})
    land(spark, str(tmp_path / "in"), ("s", "a", True, at(1)), ("s", "a", False, at(2)), ("s", "b", False, at(1)))
    store_stream(spark.readStream.schema(MARK).parquet(str(tmp_path / "in")), store, str(tmp_path / "c"), "marks", "seen", ("seen_at",)).awaitTermination()
    assert sorted((r.external_id, r.accepted) for r in store.read("seen").collect()) == [("a", True), ("b", False)]
