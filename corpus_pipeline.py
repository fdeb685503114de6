"""A corpus pipeline of five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm import decontaminate, langid, line_dedup, minhash, spm
from jobweave.llm.common import materialize, table

#: No SQL: a trained network, template trees, link components and merge-type encoding are not expressible in it.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or of no known language; null and empty texts have no letter, so they go. Rows that repeat
    are judged alike and all stay; a null doc_id is scored, not learned from. Without a labelled row no language is known. Texts of any length
    are read in windows. An empty table stays empty."""
    return langid.keep_known_languages(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of the lines of each recurring template; drops documents that had words and lost every line.
    Null and empty texts, which a caller may pass, stay as they are. Rows that repeat a doc_id and its text are one document and lose the
    same lines; a null doc_id comes last. An empty table stays empty."""
    out = line_dedup.drop_recurring_lines(docs, repeats=True)
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words a shingle, similarity 0.8 or more): the least doc_id, of equal
    ones the least hash of the text; rows without a doc_id are linked and kept like others. Rows that repeat the kept one go. Null and empty texts, and those without
    a word, are linked with nothing and stay. Words and texts may have any length. An empty table stays empty."""
    return minhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents a twentieth or more of whose words stand in benchmark windows. Null and empty texts
    have no words and stay, as do all rows if the benchmark is empty; null items have no windows. Rows that repeat are judged alike."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and digests of them and of the text that they decode to. A null text
    counts as empty and has the begin and end ids only. Rows that repeat are encoded alike; an empty table gives an empty result."""
    return spm.encode_decode(docs).drop("decoded")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`, each written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
