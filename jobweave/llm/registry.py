"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import balls, decontaminate, exact_dedup, langid, licenses, line_dedup, minhash, negatives, quality, simhash, spm, url_filter, warc
from .common import table


def op1_quality(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


def op3_line_dedup(spark, sf_dir):
    return line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), repeats=True)


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).drop("at")


def op7_warc(spark, sf_dir):
    return warc.read_archive(warc.write_archive(table(spark, sf_dir, "pages")))


def op8_language(spark, sf_dir):
    return langid.predict_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op9_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.block_list(pages))


def op10_sentencepiece(spark, sf_dir):
    return spm.encode_decode(table(spark, sf_dir, "documents"), values=False)


def op11_balls(spark, sf_dir):
    return balls.ball_kmeans(table(spark, sf_dir, "embeddings"))


def op12_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), "vec_id % 100 = 0")


def op13_simhash(spark, sf_dir):
    return simhash.near_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_decontamination, op3_line_dedup, op4_exact_dedup, op5_license_scan, op6_minhash, op7_warc, op8_language, op9_url_filter, op10_sentencepiece, op11_balls, op12_negatives, op13_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op11_balls": balls.oracle(), "op12_negatives": negatives.ORACLE, "op2_decontamination": decontaminate.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op5_license_scan": licenses.ORACLE, "op7_warc": warc.ORACLE, "op9_url_filter": url_filter.ORACLE}
