"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

A text is normalised (white space deleted) and cut where its own characters say so, so equal stretches give equal chunks
wherever they stand. Distinct chunks become verified identifiers: a 64-bit hash, and behind it an ordinal that tells
apart different chunks of one hash. Texts are equal if and only if their ordered identifier lists are, so long
texts move once, as distinct chunks; after that only short lists move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_by_key, attach_groups, materialize

WHITE = r"[\x20\x09-\x0D]"
MIN_CHUNK, MAX_CHUNK = 120, 1024
FEW = 1_000_000  # hashes of several chunks that are broadcast, at most (8 MB); more are joined by shuffling


def boundary_pattern(low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> str:
    """A chunk ends at the first two neighbours from `low` characters on whose code points are both multiples of three
    below 256, or after `high` characters; the rest of a text is its last chunk."""
    kind = "[" + "".join(f"\\x{c:02x}" for c in range(0x21, 0x100) if c % 3 == 0) + "]"
    return f"(?s).{{{low - 2},{high - 2}}}?{kind}{kind}|.{{1,{high}}}"


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def exact_duplicates(docs: DataFrame, hash_of=chunk_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts form one group. The row with the most code points in its original text
    stays, then the smallest doc_id; a null doc_id comes last. Rows that repeat a doc_id with the same text are one document
    given twice: each gets the same result row and counts in group_size. Texts may have any length: only their distinct chunks
    move. Other columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select("doc_id", F.char_length(text).cast("long").alias("n_points"), F.regexp_replace(text, WHITE, "").alias("norm"))
    cut = cut.select("doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"), F.regexp_extract_all("norm", F.lit(boundary_pattern()), F.lit(0)).alias("chunks"))

    distinct = cut.select(F.explode("chunks").alias("chunk")).select(hash_of(F.col("chunk")).alias("h"), "chunk").distinct()
    doubtful = materialize(distinct.groupBy("h").count().where("count > 1").select("h"), "chunk-collisions")
    listed = materialize(cut.select("doc_id", "n_points", "text_sha256", F.transform("chunks", hash_of).alias("recipe")), "recipes")
    keys = ["recipe"]
    if n := doubtful.limit(FEW + 1).count():
        keys, listed = ["recipe", "ordinals"], _with_ordinals(listed, cut, distinct, F.broadcast(doubtful) if n <= FEW else doubtful, hash_of)

    best = F.struct(F.col("n_points"), F.bitwise_not(F.col("doc_id")).alias("order"), F.col("doc_id"))
    grouped = attach_groups(
        listed,
        keys,
        [F.count("*").alias("n"), F.max(best).alias("best")],
        [F.sum("n").alias("group_size"), F.max("best").alias("best")],
        salt=F.col("doc_id"),
        having=F.col("group_size") > 1,
    )
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return grouped.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def _with_ordinals(listed: DataFrame, cut: DataFrame, distinct: DataFrame, doubtful: DataFrame, hash_of) -> DataFrame:
    """Recipes where some hashes have several chunks: beside the hashes stand the places at which a text has another than the first
    chunk of a hash, with the chunk's rank. Only chunks of doubtful hashes are looked at; other texts keep their recipe."""
    # The hash of a chunk is of fixed width, so a handful of chunks share one; the window is over those only.
    ranks = distinct.join(doubtful, "h", "left_semi").withColumn("ordinal", F.row_number().over(Window.partitionBy("h").orderBy("chunk"))).where("ordinal > 1")
    parts = cut.select("text_sha256", F.posexplode("chunks").alias("at", "chunk")).withColumn("h", hash_of(F.col("chunk"))).join(doubtful, "h", "left_semi")
    # Rows of one text have the same places, so a text's set is no larger than its recipe.
    places = parts.join(ranks, ["h", "chunk"]).groupBy("text_sha256").agg(F.array_sort(F.collect_set(F.struct("at", "ordinal"))).alias("ordinals"))
    flat = F.flatten(F.transform("ordinals", lambda x: F.array(x["at"], x["ordinal"])))
    out = attach_by_key(listed, places.select("text_sha256", flat.alias("ordinals")), "text_sha256", F.col("doc_id"))
    return out.withColumn("ordinals", F.coalesce("ordinals", F.array().cast("array<int>")))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -n, b := doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
