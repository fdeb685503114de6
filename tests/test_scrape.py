import datetime
import json

import pytest
from pyspark.sql import functions as F

from jobweave.functions import rules
from jobweave.operators import scrape
from jobweave.operators.store import POSTINGS, SEEN, Store
from jobweave.sources import postings as src

POSTING = "source string, external_id string, url string, title string, company string, location string, country string, raw_text string, body string"
NOW = datetime.datetime(2024, 1, 1)


def seen_rows(spark, *keys):
    return spark.createDataFrame(list(keys), "source string, external_id string")


@pytest.mark.parametrize(
    ("source", "title", "country", "location", "body", "reason"),
    [
        ("lever", "Data Engineer", "DE", "x", "fine", None),
        ("lever", "Chef", "DE", "x", "fine", "title"),
        ("lever", None, "DE", "x", "fine", "title"),
        ("lever", "Data Engineer", "us", "Texas", "fine", "region"),
        ("greenhouse", "Data Engineer", "DE", "Texas", "fine", "region"),
        ("greenhouse", "Data Engineer", None, "Berlin, Germany", '<p class="lead">', "senior"),
        ("ashby", "Data Engineer", "Germany", "x", "3-5 years", "experience"),
        ("ashby", "Data Engineer", "Germany", None, None, None),
    ],
)
def test_boards(spark, source, title, country, location, body, reason):
    rows = spark.createDataFrame([(source, None, "u", title, "c", location, country, body, body)], POSTING)
    assert scrape.board(rows).first().reason == reason


def magnet_page(languages=(), **posting):
    box = "".join(f"<div><span>{x}</span></div>" for x in languages)
    return f'<script type="application/ld+json">{json.dumps({"@type": "JobPosting", **posting})}</script><div data-testid="languages"><div>L</div><div>{box}</div></div>'


def country(code):
    return {"jobLocation": {"address": {"addressCountry": code}}}


MAGNET = {
    "https://m/chef": (None, "title"),
    "https://m/data-engineer" + rules.EXCLUDED_URLS[1]: (None, "url"),
    "https://m/senior-data-engineer": (None, "title"),
    "https://m/data-engineer/1": (magnet_page(title="Chef", description="<p>fine</p>"), None),  # the URL counts, not the title
    "https://m/data-engineer/2": ("<p>none</p>", "no_json_ld"),
    "https://m/data-engineer/3": (magnet_page(description="fine"), "no_title"),
    "https://m/data-engineer/4": (magnet_page(title="T", **country("us")), "region"),
    "https://m/data-engineer/5": (magnet_page(title="T", **country(" ")), "region"),
    "https://m/data-engineer/6": (magnet_page(["English", " dutch "], title="T", **country("NL")), "language"),
    "https://m/data-engineer/7": (magnet_page(title="T", description="<p class='lead'>You are senior</p>"), "senior"),
    "https://m/data-engineer/8": (magnet_page(title="T", description="<p class='lead'>fine</p>"), None),  # the text counts, not its HTML
    "https://m/data-engineer/9": (magnet_page(title="T", description="5+ years"), "experience"),
    "https://m/data-engineer/10": (magnet_page(description="5+ years"), "experience"),  # noticed before the title
    "https://m/data-engineer/11": (magnet_page(title=None, description="fine"), None),
    "https://m/data-engineer/12": (None, "not fetched"),
}


def magnet(spark, seen=()):
    asked = []
    urls = spark.createDataFrame([(u,) for u in [*MAGNET, "https://m/data-engineer/1"]], "url string")
    pages = spark.createDataFrame([(u, p) for u, (p, _) in MAGNET.items()], "url string, payload string")

    def fetch(rows):
        asked.extend(r.url for r in rows.collect())
        return rows.join(pages, "url")

    return scrape.magnetme(urls, seen_rows(spark, *seen) if seen else seen_rows(spark, ("x", "y")), fetch), asked


def test_magnetme_rules_and_order(spark):
    judged, asked = magnet(spark)
    got = {r.external_id: r.reason for r in judged.collect()}
    assert got == {u: reason for u, (_, reason) in MAGNET.items() if reason != "not fetched"}
    assert sorted(asked) == sorted(u for u, (_, reason) in MAGNET.items() if reason not in ("title", "url"))  # each once


def test_pass_stores_both_relations_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", {"postings": POSTINGS, "seen": SEEN})
    judged, _ = magnet(spark)
    scrape.run_pass(store, judged, F.lit(NOW), stream="magnetme", batch=1)
    accepted = {u for u, (_, reason) in MAGNET.items() if reason is None}
    rejected = {u for u, (_, reason) in MAGNET.items() if reason not in (None, "title", "url", "not fetched")}
    assert {r.url for r in store.read("postings").collect()} == accepted
    assert {(r.external_id, r.accepted) for r in store.read("seen").collect()} == {(u, True) for u in accepted} | {(u, False) for u in rejected}
    assert {r.title for r in store.read("postings").collect()} == {"Chef", "T", "null"}
    # The next pass asks only for the page that could not be fetched.
    seen = [(r.source, r.external_id) for r in store.read("seen").collect()]
    judged, asked = magnet(spark, seen)
    assert asked == ["https://m/data-engineer/12"]
    assert {r.reason for r in judged.collect()} == {"title", "url"}
    # The same batch once more changes nothing.
    before = store.manifest()
    scrape.run_pass(store, magnet(spark)[0], F.lit(NOW), stream="magnetme", batch=1)
    assert store.manifest() == before


def test_workday_and_smartrecruiters(spark):
    detail = lambda place, text, title=None: json.dumps({"jobPostingInfo": {"location": place, "jobDescription": text, **({"title": title} if title else {})}})
    pages = {"/1": detail("Berlin, Germany", "fine", "Chef"), "/2": detail("Austin", "fine"), "/3": detail("Germany", '<b class="lead">x</b>'), "/4": detail("Germany", "4 years"), "/5": "oops", "/6": None, "/7": detail("Germany", "x")}
    listing = spark.createDataFrame([("Data Engineer", k, "u" + k, "C") for k in pages] + [("Chef", "/0", "u", "C")], "title string, external_path string, url string, company string")
    details = spark.createDataFrame(list(pages.items()), "external_path string, payload string")
    judged = scrape.workday(listing, seen_rows(spark, ("workday", "/7"), ("lever", "/1")), lambda r: r.join(details, "external_path"))
    got = {r.external_id: (r.reason, r.title) for r in judged.collect()}
    assert got == {"/0": ("title", "Chef"), "/1": (None, "Chef"), "/2": ("region", "Data Engineer"), "/3": ("senior", "Data Engineer"), "/4": ("experience", "Data Engineer"), "/5": ("region", "Data Engineer")}
    assert {(r.external_id, r.accepted) for r in scrape.marks(judged, F.lit(NOW)).collect()} == {("/1", True), ("/2", False), ("/3", False), ("/4", False), ("/5", False)}

    listing = spark.createDataFrame([("Data Engineer", "1", "u1", "C", "associate"), ("Data Engineer", "2", "u2", "C", "director"), ("Data Engineer", "3", "u3", "C", None)], "title string, external_id string, url string, company string, level string")
    ads = spark.createDataFrame([("1", json.dumps({"location": {"country": "de"}, "jobAd": {"sections": {"jobDescription": {"text": "<b class='lead'>x</b>"}}}})), ("3", "{}")], "external_id string, payload string")
    judged = scrape.smartrecruiters(listing, seen_rows(spark, ("x", "y")), lambda r: r.join(ads, "external_id"))
    assert {(r.external_id, r.reason) for r in judged.collect()} == {("1", None), ("2", "level"), ("3", "region")}


def test_magnetme_adapter_still_leaves_out_pages_without_a_posting(spark):
    pages = spark.createDataFrame([(u, p) for u, (p, _) in MAGNET.items()], "url string, payload string")
    assert {r.url for r in src.magnetme(pages).collect()} == {u for u, (p, reason) in MAGNET.items() if p and reason not in ("no_json_ld", "no_title") and not u.endswith("/10")}
