"""Labels as the fold of a log of actions: what a person at the keyboard labelled, skipped and took back.

An action is label, skip, undo or read, of a session, at a time (ties: by id). An undo takes back the label last given in its
session, if no undo did so already; skips and reads between them don't matter. So a label is taken back exactly if the next label
or undo of its session is an undo, and an undo counts exactly if the one before it is a label: neighbours decide, no state is
carried along, and a session that holds most of the log is worked through in ranges of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = "session string, at timestamp, id long, kind string, vacancy_id long, label int"


def _neighbours(rows: DataFrame) -> DataFrame:
    """rows (labels and undos) with the kinds before and after each in its session."""
    here = Window.partitionBy("session", "_range").orderBy("at", "id")
    ends = rows.groupBy("session", "_range").agg(F.min_by("kind", F.struct("at", "id")).alias("first"), F.max_by("kind", F.struct("at", "id")).alias("last"))
    ranges = Window.partitionBy("session").orderBy("_range")  # a row a range
    ends = ends.select(F.col("session").alias("_s"), F.col("_range").alias("_r"), F.lag("last").over(ranges).alias("_before"), F.lead("first").over(ranges).alias("_after"))
    near = rows.withColumns({"before": F.lag("kind").over(here), "after": F.lead("kind").over(here)})
    near = near.join(ends, F.col("session").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    return near.withColumns({"before": F.coalesce("before", "_before"), "after": F.coalesce("after", "_after")}).drop("_s", "_r", "_before", "_after")


def replay(actions: DataFrame, span: str = "hour") -> DataFrame:
    """Labels and undos with `undone` (of a label: it was taken back) and `counts` (of an undo: it took one back). span: the range of time
    that is worked through as one. Actions without a time, of another kind, or labels other than 0, 1 and 2, are left out."""
    good = F.col("at").isNotNull() & ((F.col("kind") == "undo") | (F.col("kind") == "label") & F.col("label").isin(0, 1, 2) & F.col("vacancy_id").isNotNull())
    near = _neighbours(actions.where(good).withColumn("_range", F.date_trunc(span, "at")))
    sure = lambda x: F.coalesce(x, F.lit(False))
    out = near.withColumns({"undone": (F.col("kind") == "label") & sure(F.col("after") == "undo"), "counts": (F.col("kind") == "undo") & sure(F.col("before") == "label")})
    return out.drop("_range", "before", "after")


def standing_labels(actions: DataFrame, span: str = "hour") -> DataFrame:
    """vacancy_id, label, labeled_at of the labels that were not taken back; of several for one posting the first stands."""
    kept = replay(actions, span).where("kind = 'label' AND NOT undone")
    first = kept.groupBy("vacancy_id").agg(F.min_by(F.struct("label", "at"), F.struct("at", "id", "session")).alias("x"))
    return first.select("vacancy_id", "x.label", F.col("x.at").alias("labeled_at"))


def progress(actions: DataFrame, span: str = "hour") -> DataFrame:
    """By session: how far it came (labels and skips, less the undos that count), and its standing and undone labels."""
    skips = actions.where("kind = 'skip' AND at IS NOT NULL").select("session", F.lit("skip").alias("kind"), F.lit(False).alias("undone"), F.lit(False).alias("counts"))
    rows = skips.unionByName(replay(actions, span).select("session", "kind", "undone", "counts"))
    n = lambda condition: F.count_if(F.expr(condition))
    step: Column = n("kind IN ('label', 'skip')") - n("counts")
    return rows.groupBy("session").agg(step.alias("position"), n("kind = 'label' AND NOT undone").alias("n_labels"), n("undone").alias("n_undone"))
