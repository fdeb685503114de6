"""One scrape pass: what every board's payloads hold is judged once, and the verdicts feed two relations that are committed together.

A board with pages of its own for each posting (SEEN_SOURCES) is asked for those only of which a listing gives hope and that no pass
has judged yet; each judged one is marked as seen, accepted or not, so that the next pass leaves it alone. Boards that deliver all
postings at once are judged anew each time, and mark nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..session import scratch
from ..sources import postings as src
from . import state
from .store import Store, merge_postings, merge_seen

SEEN_SOURCES = ("workday", "smartrecruiters", "magnetme")
#: Gives a listing's rows with the payload of each row's own page; rows whose page could not be fetched are left out, or have a null one.
Fetch = Callable[[DataFrame], DataFrame]

DECIDED = (*src.POSTING, "reason")


def _judged(rows: DataFrame, *more: tuple[Column, str]) -> DataFrame:
    """rows of an adapter with `reason`: the first rule that a posting fails, or null. more: what comes before the text's rules."""
    out = None
    for fails, name in (*more, (rules.senior_role(F.col("body")), "senior"), (rules.too_much_experience(F.col("body")), "experience")):
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return rows.withColumn("reason", out).select(*DECIDED)


def _outside(rows: DataFrame) -> tuple[Column, str]:
    return ~rules.in_region(F.col("source"), F.col("country"), F.col("location")), "region"


def board(rows: DataFrame) -> DataFrame:
    """Judges the postings of a board that delivers all at once, its adapter's rows: title, region, senior, experience."""
    return _judged(rows, (~rules.candidate_title(F.col("title")), "title"), _outside(rows))


def _hopeless(rows: DataFrame, reason: Column, source: str) -> DataFrame:
    """Listing entries that go before anything is fetched, in the shape of judged rows."""
    known = {"source": F.lit(source), "external_id": F.col("external_id"), "title": F.col("title") if "title" in rows.columns else F.lit(None), "reason": reason}
    return rows.where(reason.isNotNull()).select(*(known.get(c, F.lit(None)).cast("string").alias(c) for c in DECIDED))


def _listed(listing: DataFrame, reason: Column, source: str, seen: DataFrame, fetch: Fetch) -> tuple[DataFrame, DataFrame]:
    """What goes by the listing alone, and the fetched pages of the rest that no pass has judged; of an entry that is listed twice,
    one is fetched."""
    listing = listing.withColumn("source", F.lit(source))
    open_ = state.unseen(listing.where(reason.isNull()).dropDuplicates(["external_id"]), seen.select("source", "external_id"))
    return _hopeless(listing, reason, source), fetch(open_).where("payload IS NOT NULL")


def workday(listing: DataFrame, seen: DataFrame, fetch: Fetch) -> DataFrame:
    """listing: workday_listing's rows with url, of the detail page, and company. The listing's title counts, the text is raw HTML."""
    listing = listing.withColumn("external_id", F.col("external_path"))
    gone, pages = _listed(listing, F.when(~rules.candidate_title(F.col("title")), "title"), "workday", seen, fetch)
    rows = src.workday(pages)
    return gone.unionByName(_judged(rows, _outside(rows)))


def smartrecruiters(listing: DataFrame, seen: DataFrame, fetch: Fetch) -> DataFrame:
    """listing: smartrecruiters_listing's rows with url and company."""
    reason = F.when(~rules.candidate_title(F.col("title")), "title").when(rules.excluded_level(F.coalesce("level", F.lit(""))), "level")
    gone, pages = _listed(listing, reason, "smartrecruiters", seen, fetch)
    rows = src.smartrecruiters(pages)
    return gone.unionByName(_judged(rows, _outside(rows)))


def magnetme(urls: DataFrame, seen: DataFrame, fetch: Fetch) -> DataFrame:
    """urls: a sitemap's. The URL stands for the title; pages without a posting, or whose posting has no title, are judged too."""
    listing = urls.withColumn("external_id", F.col("url"))
    reason = F.when(~rules.candidate_title(F.col("url")), "title").when(rules.excluded_url(F.col("url")), "url")
    gone, pages = _listed(listing, reason, "magnetme", seen, fetch)
    pages = pages.withColumn("languages", T.required_languages(F.col("payload")))
    rows = src.magnetme_pages(pages, "languages")
    judged = _judged(rows.withColumn("reason", F.lit(None).cast("string")), (F.col("problem") == "no_json_ld", "no_json_ld"), _outside(rows), (rules.requires_dutch(F.col("languages")), "language"))
    # A missing title is noticed last, when all other rules are passed.
    untitled = F.col("title").isNull() & F.col("reason").isNull()
    return gone.unionByName(judged.withColumn("reason", F.when(untitled, "no_title").otherwise(F.col("reason"))))


def marks(decided: DataFrame, now: Column) -> DataFrame:
    """Seen marks of what was fetched and judged."""
    judged = F.col("source").isin(*SEEN_SOURCES) & ~rules.sure(F.col("reason").isin("title", "level", "url"))
    return decided.where(judged).select("source", "external_id", F.col("reason").isNull().alias("accepted"), now.alias("seen_at"))


def run_pass(store: Store, decided: DataFrame, now: Column, stream: str = "", batch: int | None = None) -> DataFrame:
    """Stores the accepted postings and the seen marks of judged rows in one commit, and gives the judged rows.

    The rows are evaluated once, into a table of their own, from which both relations are fed. Accepted ones without a url can't be
    stored: they have reason no_url. Of postings with one key, the one with the greatest title, company and text counts.
    """
    spark = decided.sparkSession
    path = scratch(spark, "decided")
    keyless = F.col("reason").isNull() & F.col("url").isNull()
    decided.withColumn("reason", F.when(keyless, "no_url").otherwise(F.col("reason"))).write.parquet(path)
    rows = spark.read.parquet(path)
    order = ("title", "company", "raw_text")
    new = rows.where("reason IS NULL").select("source", "url", *state.POSTING_DATA, *(F.coalesce(c, F.lit("")).alias(f"by_{c}") for c in order))
    seen = marks(rows, now).withColumn("by", ~F.col("accepted"))
    store.merge({"postings": (new, merge_postings(now, [f"by_{c}" for c in order])), "seen": (seen, merge_seen(["by"]))}, stream=stream, batch=batch)
    return rows
