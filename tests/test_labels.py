import datetime
import random

import pytest

from jobweave.operators import labels

START = datetime.datetime(2024, 1, 1)


def log(*steps):
    """Steps of one session, a minute apart: 0 to 2 label the next posting, s skips, u undoes, r reads."""
    rows = []
    for k, s in enumerate(steps):
        kind = {"s": "skip", "u": "undo", "r": "read"}.get(s, "label")
        rows.append(("a", START + datetime.timedelta(minutes=20 * k), k, kind, k if kind != "undo" else None, s if kind == "label" else None))
    return rows


def walk(rows):
    """The session at the keyboard: one variable for the last label."""
    standing, last, out, position, undone = {}, {}, {}, {}, {}
    for session, at, _, kind, vacancy, label in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[2])):
        position.setdefault(session, 0)
        if kind == "label" and label in (0, 1, 2) and vacancy is not None:
            standing.setdefault(vacancy, []).append((at, label))
            last[session] = (vacancy, (at, label))
            position[session] += 1
        elif kind == "skip":
            position[session] += 1
        elif kind == "undo" and last.get(session):
            vacancy, entry = last.pop(session)
            standing[vacancy].remove(entry)
            position[session] -= 1
            undone[session] = undone.get(session, 0) + 1
    for vacancy, entries in standing.items():
        if entries:
            out[vacancy] = min(entries)[::-1]
    return out, position, undone


@pytest.mark.parametrize(
    "steps",
    [[0, 1, 2], [0, "u"], [0, "u", "u", 1], [0, 1, "u", "u"], [0, "s", "u"], [0, "s", "r", "s", "u", 2, "u", "u"], ["u", "s", 1], [0, "u", 1, "u", 2, "r", "u", "u", 0], []],
)
def test_one_session(spark, steps):
    rows = log(*steps)
    df = spark.createDataFrame(rows, labels.ACTIONS)
    out, position, _ = walk(rows)
    assert {r.vacancy_id: (r.label, r.labeled_at) for r in labels.standing_labels(df).collect()} == out
    assert {r.session: r.position for r in labels.progress(df).collect()} == {s: p for s, p in position.items() if any(x[3] != "read" for x in rows)}


def test_many_sessions_equal_the_walk(spark):
    rng = random.Random(7)
    rows = []
    for k in range(600):
        kind = rng.choice(["label", "label", "skip", "undo", "read", None])
        at = START + datetime.timedelta(seconds=k * rng.choice([1, 400, 4000])) if rng.random() < 0.97 else None
        rows.append((rng.choice(["a", "a", "a", "b", "c"]), at, k, kind, 1000 + k if kind != "undo" else None, rng.choice([0, 1, 2, 2, 7, None]) if kind == "label" else None))
    out, position, undone = walk(rows)
    df = spark.createDataFrame(rows, labels.ACTIONS).repartition(3)
    for span in ("hour", "year"):
        assert {r.vacancy_id: (r.label, r.labeled_at) for r in labels.standing_labels(df, span).collect()} == out
        got = {r.session: r for r in labels.progress(df, span).collect()}
        assert {s: r.position for s, r in got.items()} == position and {s: r.n_undone for s, r in got.items()} == undone


def test_a_posting_that_is_labelled_twice_keeps_the_first(spark):
    rows = [("a", START, 1, "label", 5, 0), ("b", START + datetime.timedelta(1), 2, "label", 5, 2), ("a", START + datetime.timedelta(2), 3, "undo", None, None)]
    df = spark.createDataFrame(rows, labels.ACTIONS)
    assert [(r.vacancy_id, r.label) for r in labels.standing_labels(df).collect()] == [(5, 2)]
    assert [(r.vacancy_id, r.label) for r in labels.standing_labels(df.where("id < 3")).collect()] == [(5, 0)]
