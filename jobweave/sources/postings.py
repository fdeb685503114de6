"""Sources: payloads of six kinds of job board, projected onto one relation of postings.

Payloads are rows with a `payload` (JSON, XML or HTML text) that something else fetched; a source's company comes by a join with
a small table of companies (token, company). Every adapter gives POSTING's columns; a missing value is null, never an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.parse import path

POSTING = ("source", "external_id", "url", "title", "company", "location", "country", "raw_text", "body")
#: Schemas of the payloads (fixed values: names in the boards' documents).
WORKDAY_LIST = "total INT, jobPostings ARRAY<STRUCT<title STRING, externalPath STRING>>"
GREENHOUSE = "jobs ARRAY<STRUCT<title STRING, absolute_url STRING, location STRUCT<name STRING>, company_name STRING, content STRING>>"
ASHBY = "jobs ARRAY<STRUCT<title STRING, jobUrl STRING, location STRING, address STRUCT<postalAddress STRUCT<addressCountry STRING>>, descriptionPlain STRING>>"
LEVER = "ARRAY<STRUCT<text STRING, hostedUrl STRING, country STRING, categories STRUCT<location STRING>, openingPlain STRING, descriptionPlain STRING, descriptionBodyPlain STRING, additionalPlain STRING, lists ARRAY<STRUCT<text STRING, content STRING>>>>"
SMART_LIST = "totalFound INT, content ARRAY<STRUCT<name STRING, id STRING, experienceLevel STRUCT<id STRING, label STRING>>>"


def _posting(df: DataFrame, source: str, keep: Sequence[str] = (), **columns: Column) -> DataFrame:
    """body: the text that the rules see (raw HTML for some boards). keep: columns of df that stay beside the posting's."""
    values = {"source": F.lit(source), "external_id": F.lit(None).cast("string"), "country": F.lit(None).cast("string"), **columns}
    values.setdefault("body", values["raw_text"])
    return df.select(*(values[c].alias(c) for c in POSTING), *keep)


def with_company(payloads: DataFrame, companies: DataFrame, key: str = "token") -> DataFrame:
    """Payloads with the columns of their board's row in the company table (token, company, ...); those of no listed board are left
    out. Which side is small is left to the planner, by its measured size."""
    return payloads.join(companies, key)


def workday_listing(pages: DataFrame) -> DataFrame:
    """Listing pages to company columns, title, external_path; entries without a path are left out."""
    rows = pages.withColumn("_j", F.explode(F.from_json("payload", WORKDAY_LIST)["jobPostings"]))
    return rows.where("_j.externalPath IS NOT NULL").select(*[c for c in pages.columns if c != "payload"], F.col("_j.title").alias("title"), F.col("_j.externalPath").alias("external_path"))


def page_offsets(total: Column, size: int) -> Column:
    """Offsets of the pages that a listing of that many entries takes."""
    return F.when(total > 0, F.sequence(F.lit(0), total - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))


def workday(details: DataFrame) -> DataFrame:
    """details: title, external_path, url (of the detail page), company and the detail payload."""
    p = F.col("payload")
    html = path(p, "$.jobPostingInfo.jobDescription", "")
    return _posting(
        details,
        "workday",
        external_id=F.col("external_path"),
        url=F.coalesce(path(p, "$.jobPostingInfo.externalUrl"), F.col("url")),
        title=F.coalesce(path(p, "$.jobPostingInfo.title"), F.col("title")),
        company=F.coalesce(T.blank_to_null(path(p, "$.hiringOrganization.name")), F.col("company")),
        location=path(p, "$.jobPostingInfo.location"),
        country=path(p, "$.jobPostingInfo.country.descriptor"),
        raw_text=T.html_to_text(html),
        body=html,
    )


def greenhouse(boards: DataFrame) -> DataFrame:
    rows = boards.select("company", F.explode(F.from_json("payload", GREENHOUSE)["jobs"]).alias("j"))
    html = T.unescape(F.coalesce("j.content", F.lit("")))
    return _posting(rows, "greenhouse", url=F.col("j.absolute_url"), title=F.col("j.title"), company=F.coalesce("j.company_name", "company"), location=F.col("j.location.name"), raw_text=T.html_to_text(html), body=html)


def ashby(boards: DataFrame) -> DataFrame:
    rows = boards.select("company", F.explode(F.from_json("payload", ASHBY)["jobs"]).alias("j"))
    return _posting(rows, "ashby", url=F.col("j.jobUrl"), title=F.col("j.title"), company=F.col("company"), location=F.col("j.location"), country=F.col("j.address.postalAddress.addressCountry"), raw_text=T.strip(F.coalesce("j.descriptionPlain", F.lit(""))))


def lever(boards: DataFrame) -> DataFrame:
    rows = boards.select("company", F.explode(F.from_json("payload", LEVER)).alias("j"))
    merged = T.merge_descriptions(F.array("j.openingPlain", "j.descriptionPlain", "j.descriptionBodyPlain", T.list_sections(F.col("j.lists")), "j.additionalPlain"))
    return _posting(rows, "lever", url=F.col("j.hostedUrl"), title=F.col("j.text"), company=F.col("company"), location=F.col("j.categories.location"), country=F.col("j.country"), raw_text=merged)


def smartrecruiters_listing(pages: DataFrame) -> DataFrame:
    rows = pages.withColumn("_j", F.explode(F.from_json("payload", SMART_LIST)["content"]))
    return rows.where("_j.id IS NOT NULL").select(*[c for c in pages.columns if c != "payload"], F.col("_j.name").alias("title"), F.col("_j.id").alias("external_id"), F.col("_j.experienceLevel.id").alias("level"))


def smartrecruiters(details: DataFrame) -> DataFrame:
    """details: title, external_id, url, company and the detail payload."""
    p = F.col("payload")
    return _posting(
        details,
        "smartrecruiters",
        external_id=F.col("external_id"),
        url=F.coalesce(path(p, "$.postingUrl"), F.col("url")),
        title=F.coalesce(path(p, "$.name"), F.col("title")),
        company=F.col("company"),
        location=path(p, "$.location.fullLocation"),
        country=path(p, "$.location.country"),
        raw_text=T.html_to_text(path(p, "$.jobAd.sections.jobDescription.text", "")),
    )


#: A sitemap, or an index of sitemaps; what can't be parsed stands in _bad.
SITEMAP = "url ARRAY<STRUCT<loc STRING>>, sitemap ARRAY<STRUCT<loc STRING>>, _bad STRING"
_DOCTYPE = r"(?is)^(?:\s|\x{feff}|<\?.*?\?>|<!--.*?-->)*<!DOCTYPE"


def sitemap_documents(pages: DataFrame) -> DataFrame:
    """pages with `urls` and `refused`: doctype for a document that declares one (none is ever read), malformed for one that is no
    XML, also if it is empty or null, or null. A document that is refused has no URLs at all, not those up to its fault."""
    read = F.from_xml(F.col("payload"), SITEMAP, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = pages.withColumn("_x", F.when(~F.col("payload").rlike(_DOCTYPE), read))
    refused = F.when(F.col("payload").rlike(_DOCTYPE), "doctype").when(F.col("_x").isNull() | F.col("_x._bad").isNotNull(), "malformed")
    none = F.array().cast("array<struct<loc:string>>")
    locs = F.transform(F.concat(F.coalesce("_x.url", none), F.coalesce("_x.sitemap", none)), lambda u: T.strip(u["loc"]))
    return rows.withColumn("refused", refused).withColumn("urls", F.when(F.col("refused").isNull(), F.array_compact(locs)).otherwise(F.array().cast("array<string>"))).drop("_x")


def sitemap(pages: DataFrame) -> DataFrame:
    """URLs of sitemap documents; see sitemap_documents for those that are refused."""
    return sitemap_documents(pages).select(F.explode("urls").alias("url"))


def magnetme_pages(pages: DataFrame, *more: str) -> DataFrame:
    """pages: url and html in payload. Every page has a row; `problem` says what it lacks: no_json_ld or no_title. more: columns of pages
    that stay."""
    j = F.col("j")
    # A title that is an explicit null stands as the text "null".
    rows = pages.select("url", *more, T.json_ld(F.col("payload")).alias("j")).withColumn("titled", F.array_contains(F.json_object_keys("j"), "title"))
    address = "$.jobLocation.address."
    return _posting(
        rows.withColumn("problem", F.when(j.isNull(), "no_json_ld").when(~F.col("titled"), "no_title")),
        "magnetme",
        keep=["problem", *more],
        external_id=F.col("url"),
        url=F.col("url"),
        title=F.when(F.col("titled"), path(j, "$.title", "null")),
        company=path(j, "$.hiringOrganization.name"),
        location=T.join_location(path(j, address + "addressLocality"), path(j, address + "addressCountry")),
        country=path(j, address + "addressCountry"),
        raw_text=T.html_to_text(path(j, "$.description", "")),
    )


def magnetme(pages: DataFrame) -> DataFrame:
    """Like magnetme_pages, without the pages that have no JSON-LD posting, or whose posting has no title."""
    return magnetme_pages(pages).where("problem IS NULL").drop("problem")


def all_postings(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def quarantine(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings with a key, and those without a url or title, which no table takes."""
    ok = F.col("url").isNotNull() & F.col("title").isNotNull()
    return postings.where(ok), postings.where(~ok)
