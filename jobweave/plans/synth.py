"""Postings derived from `documents`, the same in Spark and in DuckDB: the driver's tables hold no job vocabulary.

Each column picks from its pool by its own md5 digits of doc_id, so that pools combine independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POOLS = {
    "source": ("workday", "greenhouse", "ashby", "lever", "smartrecruiters", "magnetme"),
    "title": (
        "Data Engineer III", "Applied Data Scientist", "Software Engineering Intern", "Jr. Machine-Learning Developer", "Graduate AI Researcher", "Back-End Programmer", "DevOps Specialist", "Principal ML Engineer", "Lead Data Engineer", "Director of Machine Learning", "Head of Backend",
        "Account Executive", "Warehouse Operator", "Android Software Developer", "iOS Full-Stack Developer", "Mobile Backend Engineer", "React Native Programmer", "Flutter Software Developer", "Front End Developer", "Frontend DevOps", "Data Analysis Developer", "Junior Data-Analytics Engineer", "Idéai Technician", "Fullstack Developer (Sr.)", "AI & ML Generalist",
    ),
    "location": ("Hamburg, Germany", "Denver, Colorado, United States of America", "Seattle, WA", "Hyderabad, India", "Cardiff, Wales", "Poland, OH", "Gdansk", "Utrecht, Netherlands", "LYON, FRANCE", ""),
    "country_name": ("Spain", "United States of America", " austria ", "Japan", "Portugal"),
    "country_code": ("AT", "FR", "ca", "JP", " be ", "xk", "uk"),
    "phrase": ("No further remarks.", "You bring 4–6 years of practice.", "0-1 years of practice will do.", "7+ years with large systems.", "At least four years in teams.", "One year is enough.", "Begun 15 years ago.", "This internship asks for 6+ years.", "You answer to a Principal engineer.", "The firm is 45 years old, most have 1-9+ years here.", "80 years of tradition."),
    "level": ("entry_level", "mid_senior_level", "associate", "director", "executive", "Director"),
    "seniority": ("internship", "junior", "mid", "senior", "unknown"),
    "remote_policy": ("remote", "hybrid", "onsite", "unknown"),
    "language_requirement": ("English", "English, Dutch", "German", "english or german", "French , English", "", "German (B2)"),
    "skill_a": ("Python", "Java", "Spark", "SQL", "Docker"),
    "skill_b": ("Kubernetes", "PyTorch", "AWS", "Python", "Go", "Rust", "Scala"),
    "salary": ("0", "2800", "60000", "", "n/a"),
    "currency": ("EUR", "USD", "", "GBP"),
    "url_end": ("", "/nl-NL/vacature/70731/account-support-manager-afh", "/en-GB/opportunity/64360/junior-android-developer---mobgen-accenture-interactive", "/jobs"),
}


def _pick(name: str, dialect: str) -> str:
    pool = ", ".join("'" + x.replace("'", "''") + "'" for x in POOLS[name])
    digits = f"substr(md5(concat(cast(doc_id AS varchar(20)), '{name}')), 1, 7)"
    if dialect == "spark":
        return f"element_at(array({pool}), cast(conv({digits}, 16, 10) AS int) % {len(POOLS[name])} + 1)"
    return f"([{pool}])[cast('0x' || {digits} AS integer) % {len(POOLS[name])} + 1]"


def posting_sql(dialect: str, documents: str = "documents") -> str:
    """One posting a document: vacancy_id, the pools' columns, url, body and the document's own columns."""
    picks = ", ".join(f"{_pick(n, dialect)} AS {n}" for n in POOLS)
    return (
        f"SELECT *, concat('https://jobs.example.com/', cast(vacancy_id AS varchar(20)), url_end) AS url, concat(text, ' ', phrase) AS body, "
        f"concat('<div>We make <em>', title, '</em> &amp; ship it.</div><!-- x --><ol><li>', phrase, '</li></ol>') AS html, concat('[\"', skill_a, '\", \"', skill_b, '\"]') AS skills_json "
        f"FROM (SELECT doc_id AS vacancy_id, text, lang, source AS origin, {picks} FROM {documents}) p"
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(posting_sql("spark", "{docs}"), docs=spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CTE for DuckDB.
WITH = f"WITH p AS ({posting_sql('duckdb')})"
#: Label of a posting: 0, 1 or 2, from the driver's labels.
LABEL_SQL = "CASE WHEN quality = 0 THEN 1 WHEN toxic = 1 THEN 2 ELSE 0 END"
