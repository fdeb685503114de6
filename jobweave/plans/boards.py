"""Payloads of every board, derived from `documents`, and their scrape pass; each document is a posting of its own source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scrape
from ..session import scratch
from ..sources import postings as src
from . import synth

#: Raw HTML in which, for some, an attribute holds what no text says; the sitemap's URL; what was judged before.
COLUMNS = (
    "CASE WHEN vacancy_id % 3 = 0 THEN replace(html, '<div>', '<div class=\"lead\">') ELSE html END AS raw",
    "concat('https://jobs.example.com/en/', cast(vacancy_id AS varchar(20)), '/', replace(lower(title), ' ', '-'), url_end) AS slug",
    "vacancy_id % 4 = 1 AS judged",
)


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of all boards, written once: payloads are made of them in many places."""
    path = scratch(spark, "landed")
    synth.postings(spark, sf_dir).selectExpr("vacancy_id", "source", "title", "location", "country_name", "country_code", "phrase", "level", "language_requirement", "url", "url_end", "origin", "html", "body").selectExpr("*", *COLUMNS).drop("html", "url_end").write.parquet(path)
    return spark.read.parquet(path)


def _company(p: DataFrame) -> DataFrame:
    """The company table of these boards."""
    return p.select(F.col("origin").alias("token")).where("token IS NOT NULL").distinct().withColumn("company", F.concat(F.lit("Company of "), "token"))


def _json(column: Column) -> Column:
    return F.to_json(column).alias("payload")


def decided(all_: DataFrame) -> DataFrame:
    """Judged rows of one pass over all boards (landed postings); of a document whose number leaves 1 by 4, its page was judged before."""
    html, title = F.col("raw"), F.col("title")
    out = []

    p = all_.where(F.col("source") == "greenhouse")
    encoded = F.replace(F.replace(F.replace(html, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    job = F.struct(title, F.col("url").alias("absolute_url"), F.struct(F.col("location").alias("name")).alias("location"), encoded.alias("content"))
    out.append(scrape.board(src.greenhouse(src.with_company(p.select(F.col("origin").alias("token"), _json(F.struct(F.array(job).alias("jobs")))), _company(p)))))

    p = all_.where(F.col("source") == "ashby")
    job = F.struct(title, F.col("url").alias("jobUrl"), "location", F.struct(F.struct(F.col("country_name").alias("addressCountry")).alias("postalAddress")).alias("address"), F.col("body").alias("descriptionPlain"))
    out.append(scrape.board(src.ashby(src.with_company(p.select(F.col("origin").alias("token"), _json(F.struct(F.array(job).alias("jobs")))), _company(p)))))

    p = all_.where(F.col("source") == "lever")
    lists = F.array(F.struct(F.lit("What you do").alias("text"), html.alias("content")))
    job = F.struct(title.alias("text"), F.col("url").alias("hostedUrl"), F.col("country_code").alias("country"), F.struct("location").alias("categories"), F.col("phrase").alias("openingPlain"), F.col("body").alias("descriptionPlain"), lists.alias("lists"))
    out.append(scrape.board(src.lever(src.with_company(p.select(F.col("origin").alias("token"), _json(F.array(job))), _company(p)))))

    p = all_.where(F.col("source") == "workday")
    listing = p.select(F.col("origin").alias("token"), _json(F.struct(F.lit(1).alias("total"), F.array(F.struct(title, F.col("url").alias("externalPath"))).alias("jobPostings"))))
    listing = src.workday_listing(src.with_company(listing, _company(p))).withColumn("url", F.lit("detail"))
    details = p.select(F.col("url").alias("external_path"), _json(F.struct(F.struct(html.alias("jobDescription"), "location", F.struct(F.col("country_name").alias("descriptor")).alias("country"), F.col("url").alias("externalUrl")).alias("jobPostingInfo"))))
    out.append(scrape.workday(listing, _seen(p, "url"), lambda r: r.join(details, "external_path")))

    p = all_.where(F.col("source") == "smartrecruiters").withColumn("key", F.col("vacancy_id").cast("string"))
    entry = F.struct(title.alias("name"), F.col("key").alias("id"), F.struct(F.col("level").alias("id")).alias("experienceLevel"))
    listing = p.select(F.col("origin").alias("token"), _json(F.struct(F.lit(1).alias("totalFound"), F.array(entry).alias("content"))))
    listing = src.smartrecruiters_listing(src.with_company(listing, _company(p))).withColumn("url", F.lit("detail"))
    text = F.struct(F.struct(F.struct(html.alias("text")).alias("jobDescription")).alias("sections")).alias("jobAd")
    ads = p.select(F.col("key").alias("external_id"), _json(F.struct(F.col("url").alias("postingUrl"), F.struct(F.col("country_code").alias("country"), F.col("location").alias("fullLocation")).alias("location"), text)))
    out.append(scrape.smartrecruiters(listing, _seen(p, "key"), lambda r: r.join(ads, "external_id")))

    p = all_.where(F.col("source") == "magnetme")
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), F.replace("slug", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url></urlset>"))
    place = F.struct(F.struct(F.col("location").alias("addressLocality"), F.trim("country_code").alias("addressCountry")).alias("address")).alias("jobLocation")
    posting = F.to_json(F.struct(F.when(F.col("vacancy_id") % 11 != 0, "JobPosting").otherwise("Event").alias("@type"), F.when(F.col("vacancy_id") % 13 != 0, title).alias("title"), html.alias("description"), place))
    spans = F.array_join(F.transform(F.split("language_requirement", ","), lambda x: F.concat(F.lit("<div><span>"), x, F.lit("</span></div>"))), "")
    page = F.concat(F.lit('<html><script type="application/ld+json">'), F.replace(posting, F.lit("</"), F.lit("<\\/")), F.lit('</script><div data-testid="languages"><div>Languages</div><div>'), spans, F.lit("</div></div></html>"))
    pages = p.select(F.col("slug").alias("url"), page.alias("payload"))
    out.append(scrape.magnetme(src.sitemap(p.select(xml.alias("payload"))), _seen(p, "slug"), lambda r: r.join(pages, "url")))
    return reduce(DataFrame.unionByName, out)


def _seen(p: DataFrame, key: str) -> DataFrame:
    return p.where("judged").select("source", F.col(key).alias("external_id"))


def seen(all_: DataFrame) -> DataFrame:
    """What passes before this one judged."""
    key = F.when(F.col("source") == "workday", F.col("url")).when(F.col("source") == "smartrecruiters", F.col("vacancy_id").cast("string")).when(F.col("source") == "magnetme", F.col("slug"))
    return _seen(all_.withColumn("key", key).where("key IS NOT NULL"), "key")
