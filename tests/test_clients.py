import time

import pytest
from pyspark.sql import functions as F

from jobweave.operators.clients import Provider, ask_chain, embed

P = "i int, p string, n bigint, day date"


def prompts(spark, *texts, parts=1):
    return spark.createDataFrame([(k, t, None if k % 2 else k, None) for k, t in enumerate(texts)], P).coalesce(parts)


def test_the_second_is_asked_for_failed_rows_only(spark, tmp_path):
    log = str(tmp_path / "log")

    def note(name, texts):
        with open(log, "a") as f:
            f.write(f"{name}:{','.join(texts)}\n")

    def first(texts):
        note("first", texts)
        if "boom" in texts:
            raise OSError("https://x/y?key=secret")
        return [None if t == "none" else "bad" if t == "bad" else t.upper() for t in texts]

    def second(texts):
        note("second", texts)
        return [None if t == "none" else t + "2" for t in texts]

    rows = prompts(spark, "a", "none", "bad", "b", "boom", "c", None)
    out = ask_chain(rows, "p", [Provider("first", first, 2), Provider("second", second, 3)], valid=lambda x: x != "bad")
    got = {r.i: (r.response, r.provider, r.error, r.asked, r.n) for r in out.collect()}
    assert got == {
        0: ("A", "first", None, ["first"], 0),
        1: (None, None, "second: no valid answer", ["first", "second"], None),
        2: ("bad2", "second", None, ["first", "second"], 2),
        3: ("B", "first", None, ["first"], None),
        4: ("boom2", "second", None, ["first", "second"], 4),
        5: ("c2", "second", None, ["first", "second"], None),  # in the call that failed
        6: (None, None, None, [], 6),
    }
    assert open(log).read().split() == ["first:a,none", "first:bad,b", "first:boom,c", "second:none,bad,boom", "second:c"]


def test_errors_are_redacted_and_wrong_numbers_fail(spark):
    def broken(texts):
        raise OSError("see https://x/y?key=secret now")

    rows = prompts(spark, "a")
    assert [r.error for r in ask_chain(rows, "p", [Provider("x", broken)]).collect()] == ["x: OSError: see https://x/y?[redacted] now"]
    short = ask_chain(prompts(spark, "a", "b"), "p", [Provider("x", lambda t: t[:1]), Provider("y", lambda t: t)]).collect()
    assert [(r.response, r.provider) for r in short] == [("a", "y"), ("b", "y")]


def test_keys_take_turns(spark):
    rows = prompts(spark, *"abcdefg")
    got = [r.response for r in ask_chain(rows, "p", [Provider("x", lambda texts, key: [key] * len(texts), 1, keys=("k1", "k2", "k3"))]).orderBy("i").collect()]
    assert got == ["k1", "k2", "k3", "k1", "k2", "k3", "k1"]
    # Tasks begin with different keys.
    more = ask_chain(prompts(spark, *"abcdef", parts=3).repartition(3, "i"), "p", [Provider("x", lambda texts, key: [key] * len(texts), keys=("k1", "k2", "k3"))])
    by = {(r.task, r.response) for r in more.withColumn("task", F.spark_partition_id()).collect()}
    assert all(k == f"k{task % 3 + 1}" for task, k in by)


def test_rate_and_timeout(spark):
    def timed(texts):
        return [str(time.monotonic())] * len(texts)

    at = sorted(float(r.response) for r in ask_chain(prompts(spark, *"abcd"), "p", [Provider("x", timed, 1, per_second=10)]).collect())
    assert at[-1] - at[0] >= 0.29

    def slow(texts):
        if texts == ["b"]:
            time.sleep(5)
        return texts

    start = time.monotonic()
    got = {r.p: (r.response, r.provider, r.error) for r in ask_chain(prompts(spark, "a", "b", "c"), "p", [Provider("x", slow, 1, timeout=0.5), Provider("y", lambda t: [x + "y" for x in t])]).collect()}
    assert got == {"a": ("a", "x", None), "b": ("by", "y", None), "c": ("c", "x", None)} and time.monotonic() - start < 4.5


def test_vectors(spark):
    out = embed(prompts(spark, "ab", "x", None, "boom"), "p", Provider("e", lambda texts: [[float(len(t)), 0.5] if t != "x" else [] for t in texts], 1))
    assert out.schema["embedding"].dataType.simpleString() == "array<float>"
    assert {r.p: r.embedding for r in out.collect()} == {"ab": [2.0, 0.5], "x": None, None: None, "boom": [4.0, 0.5]}


def test_without_rows(spark):
    assert ask_chain(prompts(spark, "a").where("false"), "p", [Provider("x", lambda t: t)]).collect() == []
    with pytest.raises(Exception, match="nope"):
        ask_chain(prompts(spark, "a"), "nope", [Provider("x", lambda t: t)]).collect()
