"""The library's named queries and their SQL."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, rules
from ..functions import text as T
from ..operators import clients, labels, model, ranking, scrape, state
from ..operators.store import POSTINGS, SEEN, Store, merge_postings, merge_seen
from ..session import scratch, setting
from ..sources import paged
from ..sources import postings as src
from ..streaming import incremental
from . import boards, synth
from .synth import LABEL_SQL, WITH

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vacancy_id"), F.expr(LABEL_SQL).alias("label"))


_LABELS = f"l AS (SELECT doc_id AS vacancy_id, {LABEL_SQL} AS label FROM labels)"


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _match(column: str, regex: str) -> str:
    return f"regexp_matches({column}, '(?i){regex}')"


# The oracle's patterns: RE2 has no look-ahead, so 'N years ago/old' is taken out of the text first.
def _senior(c: str) -> str:
    return f"({_match(c, rules.SENIOR)} AND NOT {_match(c, rules.JUNIOR)})"


def _title(c: str) -> str:
    return f"({_match(c, rules.RELEVANT)} AND NOT {_match(c, rules.EXCLUDED_ROLE)} AND NOT {_senior(c)})"


def _years(c: str) -> str:
    cut = rf"regexp_replace({c}, '(?i)years?\s*(?:ago|old)\b', '#', 'g')"
    digits = f"len(list_filter(regexp_extract_all({cut}, '(?i){rules.YEARS}', 1), lambda n: cast(n AS integer) > 2)) > 0"
    words = f"len(list_filter(regexp_extract_all({cut}, '(?i){rules.word_years()}', 1), lambda n: list_position([{_quoted(rules.NUMBER_WORDS)}], lower(n)) > 2)) > 0"
    return f"(({digits} OR {words}) AND NOT {_match(c, rules.JUNIOR)})"


_NAME = f"lower(trim(country_name)) IN ({_quoted(rules.COUNTRIES)})"
_CODE = f"lower(trim(country_code)) IN ({_quoted(rules.COUNTRY_CODES)})"
_PLACE = f"regexp_matches(lower(location), '{'|'.join(rules.COUNTRIES)}')"
_REGION = f"CASE WHEN source IN ('workday', 'ashby') THEN {_NAME} OR {_PLACE} WHEN source = 'greenhouse' THEN {_PLACE} WHEN source = 'magnetme' THEN {_CODE} ELSE {_CODE} OR {_PLACE} END"
#: What each board's rules see, and their order; see boards.py for the payloads.
_SEES = "CASE WHEN source IN ('workday', 'greenhouse') THEN raw WHEN source = 'ashby' THEN body ELSE CASE WHEN source = 'lever' THEN body || chr(10) ELSE '' END || 'We make ' || chr(10) || title || chr(10) || ' & ship it.' || chr(10) || phrase END"
_BOARDS = f"{WITH}, b AS (SELECT *, {_SEES} AS sees FROM (SELECT *, {', '.join(boards.COLUMNS)} FROM p))"
_ENDS = " OR ".join(f"ends_with(slug, '{u}')" for u in rules.EXCLUDED_URLS)
_DUTCH = "list_has_any(list_transform(string_split(language_requirement, ','), lambda t: lower(trim(t))), ['dutch'])"
_LISTED = f"CASE WHEN source = 'magnetme' THEN CASE WHEN NOT {_title('slug')} THEN 'title' WHEN {_ENDS} THEN 'url' END WHEN NOT {_title('title')} THEN 'title' WHEN source = 'smartrecruiters' AND level IN ({_quoted(rules.EXCLUDED_LEVELS)}) THEN 'level' END"
_REASON = f"CASE WHEN source = 'magnetme' AND vacancy_id % 11 = 0 THEN 'no_json_ld' WHEN NOT ({_REGION}) THEN 'region' WHEN source = 'magnetme' AND {_DUTCH} THEN 'language' WHEN {_senior('sees')} THEN 'senior' WHEN {_years('sees')} THEN 'experience' WHEN source = 'magnetme' AND vacancy_id % 13 = 0 THEN 'no_title' ELSE 'accepted' END"
_MARKED = "source IN ('workday', 'smartrecruiters', 'magnetme')"
_DECIDED = f"{_BOARDS}, r AS (SELECT source, judged, {_MARKED} AS marked, {_LISTED} AS listed, {_REASON} AS reason FROM b)"


def _country() -> Column:
    return F.when(F.col("source").isin("workday", "ashby"), F.col("country_name")).otherwise(F.col("country_code"))


@query(f"{WITH} SELECT vacancy_id, {_match('title', rules.RELEVANT)} AS relevant, {_match('title', rules.EXCLUDED_ROLE)} AS excluded, {_title('title')} AS candidate FROM p")
def candidate_title_filter(spark, d):
    t = F.col("title")
    return synth.postings(spark, d).select("vacancy_id", rules.relevant_title(t).alias("relevant"), rules.excluded_role(t).alias("excluded"), rules.candidate_title(t).alias("candidate"))


@query(f"{WITH} SELECT vacancy_id, {_senior('title')} AS senior_title, {_senior('body')} AS senior_body FROM p")
def seniority_filter(spark, d):
    return synth.postings(spark, d).select("vacancy_id", rules.senior_role(F.col("title")).alias("senior_title"), rules.senior_role(F.col("body")).alias("senior_body"))


@query(f"{WITH} SELECT vacancy_id, {_years('body')} AS too_much FROM p")
def experience_filter(spark, d):
    return synth.postings(spark, d).select("vacancy_id", rules.too_much_experience(F.col("body")).alias("too_much"))


@query(f"{WITH} SELECT vacancy_id, {_NAME} AS by_name, {_CODE} AS by_code, {_PLACE} AS by_text FROM p")
def region_filter(spark, d):
    return synth.postings(spark, d).select("vacancy_id", rules.country_in_region(F.col("country_name")).alias("by_name"), rules.code_in_region(F.col("country_code")).alias("by_code"), rules.text_in_region(F.col("location")).alias("by_text"))


@query(f"{WITH} SELECT source, {_REGION} AS in_region, count(*) AS n FROM p GROUP BY ALL")
def region_by_source(spark, d):
    p = synth.postings(spark, d)
    return p.groupBy("source", rules.in_region(F.col("source"), _country(), F.col("location")).alias("in_region")).agg(F.count("*").alias("n"))


@query(f"{_DECIDED} SELECT source, coalesce(listed, reason) AS reason, count(*) AS n FROM r WHERE NOT (marked AND judged AND listed IS NULL) GROUP BY ALL")
def reject_reason_counts(spark, d):
    """The first rule that each posting of each board fails, as its payload has it."""
    return boards.decided(boards.landed(spark, d)).groupBy("source", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"{_DECIDED} SELECT source, coalesce(listed, reason) AS reason, count(*) AS n, count(*) FILTER (listed IS NULL AND reason = 'accepted') AS n_stored, count(*) FILTER (marked AND listed IS NULL) AS n_marked, "
    "count(*) FILTER (marked AND listed IS NULL AND reason = 'accepted') AS n_marked_accepted FROM r WHERE NOT (marked AND judged AND listed IS NULL) GROUP BY ALL"
)
def scrape_pass(spark, d):
    """One pass over all boards: judged once, accepted postings and seen marks stored in one commit."""
    kept = Store(spark, scratch(spark, "store"), {"postings": POSTINGS, "seen": SEEN})
    now = F.lit("2024-01-01").cast("timestamp")
    landed = boards.landed(spark, d)
    before = boards.seen(landed).select("source", "external_id", F.lit(False).alias("accepted"), F.lit("2023-01-01").cast("timestamp").alias("seen_at"), F.lit(0).alias("ordinal"))
    kept.merge({"seen": (before, merge_seen())})
    decided = scrape.run_pass(kept, boards.decided(landed), now)
    stored = kept.read("postings").select("source", "url", F.lit(1).alias("stored"))
    marked = kept.read("seen").where(F.col("seen_at") == now).select("source", "external_id", "accepted")
    rows = decided.join(stored, ["source", "url"], "left").join(marked, ["source", "external_id"], "left")
    return rows.groupBy("source", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.count("stored").alias("n_stored"), F.count("accepted").alias("n_marked"), F.count_if("accepted").alias("n_marked_accepted"))


@query(f"{WITH} SELECT vacancy_id, level FROM p WHERE level NOT IN ({_quoted(rules.EXCLUDED_LEVELS)})")
def level_exclusion(spark, d):
    return synth.postings(spark, d).where(~rules.excluded_level(F.col("level"))).select("vacancy_id", "level")


@query(f"{WITH} SELECT vacancy_id, url FROM p WHERE NOT ({' OR '.join(f'''ends_with(url, '{u}')''' for u in rules.EXCLUDED_URLS)})")
def url_suffix_exclusion(spark, d):
    return synth.postings(spark, d).where(~rules.excluded_url(F.col("url"))).select("vacancy_id", "url")


@query(f"{WITH} SELECT vacancy_id, language_requirement, list_has_any(list_transform(string_split(language_requirement, ','), lambda t: lower(trim(t))), ['dutch']) AS dutch FROM p")
def dutch_required(spark, d):
    return synth.postings(spark, d).select("vacancy_id", "language_requirement", rules.requires_dutch(F.split("language_requirement", ",")).alias("dutch"))


@query(f"{WITH} SELECT count(*) AS n_before, count(*) FILTER (NOT list_has_any(list_transform(string_split(language_requirement, ','), lambda t: lower(trim(t))), [{_quoted(rules.LANGUAGES)}])) AS n_after FROM p")
def non_english_filter(spark, d):
    return synth.postings(spark, d).agg(F.count("*").alias("n_before"), F.count_if(~rules.requires_other_language(F.col("language_requirement"))).alias("n_after"))


#: The oracle's own table: the references that the tables and the synthesised postings hold; the ampersand comes after them.
ORACLE_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", chr(160)), ("&copy;", chr(169)), ("&middot;", chr(183)), ("&rsquo;", chr(8217)), ("&#8211;", chr(8211)), ("&eacute;", chr(233)), ("&#x20AC;", chr(8364)))


#: The oracle's own idea of markup, enough for the tables.
ORACLE_MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[/!a-z](?:\"[^\"]*\"|[^\">])*>"


def _sql_text(c: str) -> str:
    """HTML to text, for DuckDB."""
    out = f"array_to_string(list_filter(regexp_split_to_array({c}, '{ORACLE_MARKUP}'), lambda x: len(x) > 0), chr(10))"
    for name, char in ORACLE_ENTITIES:
        out = f"replace({out}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    out = f"regexp_replace({out}, '&amp;?', '&', 'g')"
    return rf"regexp_replace({out}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, {_sql_text('html')} AS content FROM pages")
def html_to_text(spark, d):
    return _table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("content"))


@query("SELECT page_id, md5(url) || chr(10) || 'tail' || chr(10) || '<b>' || md5(html) || '&</b>' || chr(10) || 'end' || chr(10) || 'b> ' || chr(10) || 'fin' || chr(10) || '& <3' AS content FROM pages WHERE url IS NOT NULL AND html IS NOT NULL")
def html_tokens(spark, d):
    """Quoted tag ends, comments in which tags stand, elements whose contents are no markup; the result is known without a parser."""
    url = F.replace(F.replace("url", F.lit('"'), F.lit("%22")), F.lit("'"), F.lit("%27"))
    page = F.concat(
        F.lit('<p title="'), url, F.lit(" > x\" data-a='<b>' c = >"), F.md5("url"), F.lit("</p><!-- <i>no</i> -- > --><!-->tail<textarea rows='>'><b>"), F.md5("html"),
        F.lit("&amp;</b></TextArea\n><script>if (1<2) '</b>';</script ><STYLE>x</style>end<br/ class=a\"b>b> <?php no ?></ no>fin</>&amp; <3 <a href='"), url,
    )
    return _table(spark, d, "pages").where("url IS NOT NULL AND html IS NOT NULL").select("page_id", T.html_to_text(page).alias("content"))


_ENTITIES_ROW = "'caf&eacute; &rsquo;' || lang || '&rsquo; &#8211; &#x20AC;50k &lt;b&gt; R&amp;amp;D'"


@query(f"SELECT doc_id AS vacancy_id, 'caf' || chr(233) || ' ' || chr(8217) || lang || chr(8217) || ' ' || chr(8211) || ' ' || chr(8364) || '50k <b> R&amp;D' AS content FROM documents")
def html_unescape_all(spark, d):
    """Named, decimal and hexadecimal references; the whole list of names is tested against the standard library."""
    return _table(spark, d, "documents").select(F.col("doc_id").alias("vacancy_id"), T.unescape(F.expr(_ENTITIES_ROW)).alias("content"))


@query("SELECT page_id, regexp_replace(url, '\\?.*$', '?[redacted]') AS redacted FROM pages")
def redacted_urls(spark, d):
    return _table(spark, d, "pages").select("page_id", T.redact_query(F.col("url")).alias("redacted"))


def _magnet_pages(spark, d) -> DataFrame:
    p = synth.postings(spark, d)
    job = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), "title", F.col("html").alias("description"), F.struct(F.col("origin").alias("name")).alias("hiringOrganization"), F.struct(F.struct(F.col("location").alias("addressLocality"), F.trim("country_code").alias("addressCountry")).alias("address")).alias("jobLocation")))
    page = F.concat(F.lit('<html><script id="a > b" type=application/ld+json>{broken</script><!-- <script type="application/ld+json">{"@type": "JobPosting"}</script> --><script type="application/ld+json">{"@type": "Other"}</script><script data-x="</script>" type = \' Application/LD+JSON\'>'), F.replace(job, F.lit("</"), F.lit("<\\/")), F.lit("</script></html>"))
    return p.select("url", page.alias("payload"))


_JOINED = "CASE WHEN location = '' THEN trim(country_code) ELSE location || ', ' || trim(country_code) END"
_BUILT = "'We make ' || chr(10) || title || chr(10) || ' & ship it.' || chr(10) || phrase"


@query(f"{WITH} SELECT url, title, origin AS company, {_JOINED} AS location, trim(country_code) AS country, {_BUILT} AS raw_text FROM p")
def json_ld_posting(spark, d):
    return src.magnetme(_magnet_pages(spark, d)).select("url", "title", "company", "location", "country", "raw_text")


@query(f"{WITH} SELECT vacancy_id, CASE WHEN contains(body, title) THEN body ELSE body || chr(10) || chr(10) || title END AS merged FROM (SELECT vacancy_id, title, regexp_replace(body, '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g') AS body FROM p)")
def merge_descriptions(spark, d):
    parts = F.array(F.lit(" "), F.col("phrase"), F.col("text"), F.col("body"), F.col("phrase"), F.concat(F.lit("\n"), F.col("title"), F.lit(" ")))
    return synth.postings(spark, d).select("vacancy_id", T.merge_descriptions(parts).alias("merged"))


def _projection(df: DataFrame) -> DataFrame:
    return df.select("url", "title", "company", "location", "country", "raw_text")


@query(f"{WITH} SELECT url, title, CASE WHEN vacancy_id % 2 = 0 THEN origin ELSE 'Config Inc' END AS company, location, country_name AS country, {_BUILT} AS raw_text FROM p")
def source_projection_workday(spark, d):
    p = synth.postings(spark, d)
    listing = p.select(F.to_json(F.struct(F.lit(1).alias("total"), F.array(F.struct("title", F.concat(F.lit("/job/"), F.col("vacancy_id").cast("string")).alias("externalPath"))).alias("jobPostings"))).alias("payload"))
    name = F.when(F.col("vacancy_id") % 2 == 0, F.col("origin")).otherwise(" ")
    detail = p.select(F.concat(F.lit("/job/"), F.col("vacancy_id").cast("string")).alias("external_path"), F.to_json(F.struct(F.struct(F.col("html").alias("jobDescription"), "location", F.struct(F.col("country_name").alias("descriptor")).alias("country"), F.col("url").alias("externalUrl")).alias("jobPostingInfo"), F.struct(name.alias("name")).alias("hiringOrganization"))).alias("payload"))
    rows = src.workday_listing(listing).join(detail, "external_path").withColumns({"company": F.lit("Config Inc"), "url": F.lit("detail")})
    return _projection(src.workday(rows))


@query(f"{WITH} SELECT url, title, CASE WHEN vacancy_id % 2 = 0 THEN origin ELSE 'Config Inc' END AS company, location, cast(NULL AS varchar) AS country, {_BUILT} AS raw_text FROM p")
def source_projection_greenhouse(spark, d):
    p = synth.postings(spark, d)
    encoded = F.replace(F.replace(F.replace("html", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    job = F.struct("title", F.col("url").alias("absolute_url"), F.struct(F.col("location").alias("name")).alias("location"), F.when(F.col("vacancy_id") % 2 == 0, F.col("origin")).alias("company_name"), encoded.alias("content"))
    return _projection(src.greenhouse(p.select(F.lit("Config Inc").alias("company"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("payload"))))


def _companies(spark, d) -> DataFrame:
    """The company table: a token of a board and the company's name."""
    return _table(spark, d, "documents").select(F.col("source").alias("token")).where("token <> ''").distinct().withColumn("company", F.concat(F.lit("Company of "), F.col("token")))


@query(f"{WITH} SELECT url, title, 'Company of ' || origin AS company, location, country_name AS country, phrase AS raw_text FROM p WHERE origin <> ''")
def source_projection_ashby(spark, d):
    p = synth.postings(spark, d)
    job = F.struct("title", F.col("url").alias("jobUrl"), "location", F.struct(F.struct(F.col("country_name").alias("addressCountry")).alias("postalAddress")).alias("address"), F.concat(F.lit(" \n"), F.col("phrase"), F.lit("\t")).alias("descriptionPlain"))
    boards = src.with_company(p.select(F.col("origin").alias("token"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("payload")), _companies(spark, d))
    return _projection(src.ashby(boards))


@query(f"{WITH} SELECT url, title, 'Config Inc' AS company, location, country_code AS country, phrase || ' And more.' || chr(10) || chr(10) || 'What you do' || chr(10) || {_BUILT} AS raw_text FROM p")
def source_projection_lever(spark, d):
    p = synth.postings(spark, d)
    lists = F.array(F.struct(F.lit("What you do").alias("text"), F.col("html").alias("content")), F.struct(F.lit("Empty").alias("text"), F.lit("<p></p>").alias("content")))
    job = F.struct(F.col("title").alias("text"), F.col("url").alias("hostedUrl"), F.col("country_code").alias("country"), F.struct("location").alias("categories"), F.col("phrase").alias("openingPlain"), F.concat("phrase", F.lit(" And more.")).alias("descriptionPlain"), F.col("phrase").alias("additionalPlain"), lists.alias("lists"))
    return _projection(src.lever(p.select(F.lit("Config Inc").alias("company"), F.to_json(F.array(job)).alias("payload"))))


@query(f"{WITH} SELECT url, title, 'Config Inc' AS company, location, country_code AS country, {_BUILT} AS raw_text FROM p WHERE level NOT IN ({_quoted(rules.EXCLUDED_LEVELS)})")
def source_projection_smartrecruiters(spark, d):
    p = synth.postings(spark, d)
    id_ = F.col("vacancy_id").cast("string").alias("id")
    listing = p.select(F.to_json(F.struct(F.lit(1).alias("totalFound"), F.array(F.struct(F.col("title").alias("name"), id_, F.struct(F.col("level").alias("id")).alias("experienceLevel"))).alias("content"))).alias("payload"))
    detail = p.select(id_.alias("external_id"), F.to_json(F.struct(F.col("url").alias("postingUrl"), F.struct(F.col("country_code").alias("country"), F.col("location").alias("fullLocation")).alias("location"), F.struct(F.struct(F.struct(F.col("html").alias("text")).alias("jobDescription")).alias("sections")).alias("jobAd"))).alias("payload"))
    wanted = src.smartrecruiters_listing(listing).where(~rules.excluded_level(F.col("level")))
    return _projection(src.smartrecruiters(wanted.join(detail, "external_id").withColumns({"company": F.lit("Config Inc"), "url": F.lit("detail")})))


@query(f"{WITH} SELECT url FROM p")
def sitemap_urls(spark, d):
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), F.col("url"), F.lit("</loc></url></urlset>"))
    return src.sitemap(synth.postings(spark, d).select(xml.alias("payload")))


@query(f"{WITH} SELECT CASE WHEN vacancy_id % 7 = 0 THEN 'doctype' WHEN vacancy_id % 5 = 0 OR vacancy_id % 11 = 0 THEN 'malformed' ELSE 'accepted' END AS outcome, count(*) AS n, coalesce(sum(CASE WHEN vacancy_id % 7 <> 0 AND vacancy_id % 5 <> 0 AND vacancy_id % 11 <> 0 THEN 2 END), 0)::BIGINT AS n_urls FROM p GROUP BY ALL")
def sitemap_outcomes(spark, d):
    """Documents that were taken and refused: some declare a document type, some break off behind their first URL, some are empty."""
    head = F.when(F.col("vacancy_id") % 7 == 0, F.lit('<?xml version="1.0"?><!-- x -->\n<!DOCTYPE urlset [<!ENTITY x "y">]>')).otherwise(F.lit('<?xml version="1.0"?>\n<!-- <!DOCTYPE x> -->'))
    end = F.when(F.col("vacancy_id") % 5 != 0, F.lit("</loc></url></urlset>")).otherwise(F.lit("</loc>"))
    xml = F.concat(head, F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), F.col("url"), F.lit("</loc></url><url><loc>"), F.col("url"), F.lit("/more"), end)
    xml = F.when((F.col("vacancy_id") % 11 != 0) | (F.col("vacancy_id") % 7 == 0), xml).otherwise("")
    out = src.sitemap_documents(synth.postings(spark, d).select(xml.alias("payload")))
    return out.groupBy(F.coalesce("refused", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.size("urls")).alias("n_urls"))


# Upserts: events stand in for postings, (event_type, user_id) for (source, url), (ts, event_id) for the order of arrival.
_LAST = "arg_max(cast(event_id AS varchar), struct_pack(a := ts, b := event_id))"


@query(
    f"SELECT event_type AS source, cast(user_id AS varchar) AS url, {_LAST} AS title, {_LAST} || ' Inc' AS company, 'at ' || {_LAST} AS location, 'text ' || {_LAST} AS raw_text, CASE WHEN bool_or(event_id % 2 = 0) THEN user_id END AS known_id, "
    "TIMESTAMP '2024-01-01' AS scraped_at, CASE WHEN bool_or(event_id % 2 = 0) THEN TIMESTAMP '2000-01-01' ELSE TIMESTAMP '2024-01-01' END AS first_seen, TIMESTAMP '2024-01-01' AS last_seen FROM events GROUP BY event_type, user_id"
)
def upsert_latest(spark, d):
    n = F.col("event_id").cast("string")
    e = _table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("url"), n.alias("title"), F.concat(n, F.lit(" Inc")).alias("company"), F.concat(F.lit("at "), n).alias("location"), F.concat(F.lit("text "), n).alias("raw_text"), F.struct("ts", "event_id").alias("ordinal"), "event_id")
    early, now = F.lit("2000-01-01").cast("timestamp_ntz"), F.lit("2024-01-01").cast("timestamp_ntz")
    # A first pass takes the even events, a second one all of them: known keys keep id (here the user's number) and first_seen.
    empty = e.select(F.lit(0).cast("long").alias("id"), "source", "url", *state.POSTING_DATA, *(early.alias(c) for c in ("scraped_at", "first_seen", "last_seen"))).where("false")
    once = state.upsert_postings(empty, e.where("event_id % 2 = 0"), early).withColumn("id", F.col("url").cast("long"))
    twice = state.upsert_postings(once, e, now)
    known = F.when(F.col("first_seen") == early, F.col("id"))
    return twice.select("source", "url", *state.POSTING_DATA, known.alias("known_id"), "scraped_at", "first_seen", "last_seen")


@query(
    f"SELECT event_type AS source, cast(user_id AS varchar) AS url, {_LAST} AS title, {_LAST} || ' Inc' AS company, 'at ' || {_LAST} AS location, 'text ' || {_LAST} AS raw_text, "
    "TIMESTAMP '2024-01-01' AS scraped_at, CASE WHEN bool_or(event_id % 2 = 0) THEN TIMESTAMP '2000-01-01' ELSE TIMESTAMP '2024-01-01' END AS first_seen, TIMESTAMP '2024-01-01' AS last_seen FROM events GROUP BY event_type, user_id"
)
def bucketed_upsert(spark, d):
    """upsert_latest in a store of buckets: the even events in one commit, all of them in another."""
    n = F.col("event_id").cast("string")
    e = _table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("url"), n.alias("title"), F.concat(n, F.lit(" Inc")).alias("company"), F.concat(F.lit("at "), n).alias("location"), F.concat(F.lit("text "), n).alias("raw_text"), "ts", "event_id")
    kept = Store(spark, scratch(spark, "store"), {"postings": POSTINGS})
    for rows, day in ((e.where("event_id % 2 = 0"), "2000-01-01"), (e, "2024-01-01")):
        kept.merge({"postings": (rows, merge_postings(F.lit(day).cast("timestamp"), ["ts", "event_id"]))})
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("scraped_at", "first_seen", "last_seen")]
    return kept.read("postings").select("source", "url", *state.POSTING_DATA, *times)


@query("SELECT event_type AS source, cast(user_id AS varchar) AS external_id, arg_min(event_id, struct_pack(a := event_id % 2, b := ts, c := event_id)) AS evaluation FROM events GROUP BY event_type, user_id")
def seen_insert_ignore(spark, d):
    e = _table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("external_id"), F.col("event_id").alias("evaluation"), F.struct("ts", "event_id").alias("ordinal"))
    columns = ["source", "external_id", "evaluation"]
    seen = state.mark_seen(e.select(*columns).where("false"), e.where("evaluation % 2 = 0"))
    return state.mark_seen(seen, e)


@query(
    "SELECT event_type AS source, cast(user_id AS varchar) AS external_id, arg_min(event_id % 3 = 0, struct_pack(a := ts, b := event_id % 3 = 0)) AS accepted, min(ts) AS seen_at "
    "FROM events WHERE user_id % 2 = 1 AND ts IS NOT NULL GROUP BY event_type, user_id"
)
def seen_stream(spark, d):
    """First evaluations as a stream that never forgets; keys of even users were evaluated before the stream began."""
    e = lambda df: df.select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("external_id"), (F.col("event_id") % 3 == 0).alias("accepted"), F.col("ts").cast("timestamp").alias("seen_at"))
    table = _table(spark, d, "events")
    before = state.first_wins(e(table.where("user_id % 2 = 0")), ["source", "external_id"], ["seen_at", "accepted"])
    out, provider = scratch(spark, "seen"), "spark.sql.streaming.stateStore.providerClass"
    with setting(spark, provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        fresh = incremental.first_evaluations(e(spark.readStream.schema(table.schema).parquet(f"{d}/events.parque[t]")), before)  # as a pattern, a single file may stand there
        fresh.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(incremental.MARK).parquet(f"{out}/rows").withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))


@query("SELECT user_id AS vacancy_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS extraction FROM events GROUP BY user_id")
def upsert_extraction(spark, d):
    e = _table(spark, d, "events").select(F.col("user_id").alias("vacancy_id"), F.col("event_id").alias("extraction"), "ts")
    first = state.latest(e.where("extraction % 3 = 0"), ["vacancy_id"], ["ts", "extraction"]).select("vacancy_id", "extraction")
    return state.upsert_by_key(first, e, "vacancy_id", ["ts", "extraction"])


@query(f"{WITH} SELECT vacancy_id AS id, length(text) AS n FROM p WHERE text IS NOT NULL AND text <> '' AND vacancy_id % 3 <> 0")
def unextracted(spark, d):
    p = synth.postings(spark, d)
    done = p.where("vacancy_id % 3 = 0").select("vacancy_id")
    return state.pending_extraction(p.select(F.col("vacancy_id").alias("id"), F.col("text").alias("raw_text")), done).select("id", F.length("raw_text").alias("n"))


@query(f"{WITH} SELECT vacancy_id, title, seniority FROM p WHERE vacancy_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vacancy_id)")
def unlabeled(spark, d):
    p = synth.postings(spark, d)
    done = p.where("vacancy_id % 3 = 0").select("vacancy_id", "seniority")
    return state.pending_labels(p.select(F.col("vacancy_id").alias("id"), "title"), done, _labels(spark, d)).select("vacancy_id", "title", "seniority")


@query(f"{WITH} SELECT source, cast(vacancy_id AS varchar) AS external_id FROM p WHERE vacancy_id NOT IN (SELECT doc_id FROM labels)")
def seen_probe(spark, d):
    p = synth.postings(spark, d).select("source", F.col("vacancy_id").cast("string").alias("external_id"))
    seen = p.join(_labels(spark, d).select(F.col("vacancy_id").cast("string").alias("external_id")), "external_id", "left_semi")
    return state.unseen(p, seen).select("source", "external_id")


@query("SELECT doc_id AS vacancy_id FROM labels WHERE doc_id % 5 <> 0")
def undo_labels(spark, d):
    labels = _labels(spark, d)
    return state.delete_labels(labels, labels.where("vacancy_id % 5 = 0").select("vacancy_id")).select("vacancy_id")


# A log of labelling actions: an event's number says what was done, its user is the session.
_ACTIONS = "a AS (SELECT user_id AS session, ts, event_id AS id, CASE WHEN event_id % 10 < 6 THEN 'label' WHEN event_id % 10 < 7 THEN 'skip' WHEN event_id % 10 < 9 THEN 'undo' ELSE 'read' END AS kind, event_id % 997 AS vacancy_id, cast(event_id % 3 AS integer) AS label FROM events)"
_REPLAYED = f"{_ACTIONS}, m AS (SELECT *, coalesce(kind = 'label' AND lead(kind) OVER w = 'undo', false) AS undone, coalesce(kind = 'undo' AND lag(kind) OVER w = 'label', false) AS counts FROM a WHERE kind IN ('label', 'undo') WINDOW w AS (PARTITION BY session ORDER BY ts, id))"


def _actions(spark, d) -> DataFrame:
    n = F.col("event_id")
    kind = F.when(n % 10 < 6, "label").when(n % 10 < 7, "skip").when(n % 10 < 9, "undo").otherwise("read")
    return _table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.col("ts").alias("at"), n.alias("id"), kind.alias("kind"), (n % 997).alias("vacancy_id"), (n % 3).cast("int").alias("label"))


@query(f"WITH {_REPLAYED} SELECT vacancy_id, arg_min(label, struct_pack(a := ts, b := id)) AS label, min(ts) AS labeled_at FROM m WHERE kind = 'label' AND NOT undone GROUP BY vacancy_id")
def label_log(spark, d):
    """Labels that stand at the end of the log."""
    return labels.standing_labels(_actions(spark, d))


@query(f"WITH {_REPLAYED}, s AS (SELECT session, kind, undone, counts FROM m UNION ALL SELECT session, kind, false, false FROM a WHERE kind = 'skip') SELECT cast(session AS varchar) AS session, count(*) FILTER (kind <> 'undo') - count(*) FILTER (counts) AS position, count(*) FILTER (kind = 'label' AND NOT undone) AS n_labels, count(*) FILTER (undone) AS n_undone FROM s GROUP BY session")
def label_progress(spark, d):
    return labels.progress(_actions(spark, d))


@query(f"{WITH}, {_LABELS} SELECT vacancy_id, title, seniority, label FROM p JOIN l USING (vacancy_id)")
def labeled_join(spark, d):
    p = synth.postings(spark, d)
    return state.labeled(_labels(spark, d), p.select(F.col("vacancy_id").alias("id"), "title"), p.select("vacancy_id", "seniority")).select("vacancy_id", "title", "seniority", "label")


@query(f"WITH {_LABELS} SELECT vacancy_id, (row_number() OVER (ORDER BY md5('42:' || vacancy_id)) - 1)::BIGINT AS place FROM l")
def shuffled_places(spark, d):
    """The repeatable random order in which postings are shown: each one's place, numbered by ranges."""
    rows = _labels(spark, d).select("vacancy_id", F.md5(F.concat(F.lit("42:"), F.col("vacancy_id").cast("string"))).alias("digest"))
    return rows.join(model.ordinals(rows, "digest"), "digest").select("vacancy_id", F.col("ordinal").alias("place"))


_P = "[abs(embedding[1]::DOUBLE), abs(embedding[2]::DOUBLE), abs(embedding[3]::DOUBLE)]"


@query(f"SELECT vec_id AS vacancy_id, round((p[2] + 2 * p[3]) / list_sum(p), 9) AS rating FROM (SELECT vec_id, {_P} AS p FROM embeddings) WHERE list_sum(p) > 0")
def expected_ratings(spark, d):
    """Expected label of a posting, of the labels' probabilities: three components' shares stand for them."""
    size = F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x.cast("double")))
    rows = _table(spark, d, "embeddings").select("vec_id", size.alias("p")).withColumn("total", F.aggregate("p", F.lit(0.0), lambda a, x: a + x)).where("total > 0")
    return rows.select(F.col("vec_id").alias("vacancy_id"), F.round(ranking.expected_rating(F.transform("p", lambda x: x / F.col("total"))), 9).alias("rating"))


@query(f"WITH {_LABELS} SELECT k AS label, count(vacancy_id) AS n FROM range(3) t(k) LEFT JOIN l ON label = k GROUP BY k")
def label_counts(spark, d):
    return ranking.label_counts(_labels(spark, d))


_SKILLS = "from_json(skills_json, '[\"VARCHAR\"]')"


def _with_skills(spark, d) -> DataFrame:
    return synth.postings(spark, d).withColumn("skills", parse.parse_skills(F.col("skills_json")))


@query(f"{WITH} SELECT skill, count(*) AS n FROM (SELECT unnest({_SKILLS}) AS skill FROM p) GROUP BY skill HAVING count(*) >= 3")
def skill_vocab(spark, d):
    return model.skill_vocabulary(_with_skills(spark, d))


@query(f"{WITH} SELECT DISTINCT seniority AS category FROM p")
def category_vocab(spark, d):
    return model.categories(synth.postings(spark, d), "seniority")


_COS = "round(list_cosine_similarity(cast(e.embedding AS double[]), cast(q.embedding AS double[])), 6)"


def _cosines(spark, d) -> DataFrame:
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("vacancy_id"), "embedding")
    return ranking.against_profile(e, e.where("vacancy_id = 0")).select("vacancy_id", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT e.vec_id AS vacancy_id, {_COS} AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def cosine_rank(spark, d):
    return _cosines(spark, d)


@query(f"SELECT e.vec_id AS vacancy_id, {_COS} AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY cosine DESC, vacancy_id LIMIT 20")
def top_k(spark, d):
    return ranking.top_k(_cosines(spark, d), "cosine", "vacancy_id", 20)


_SCORES = f"{_LABELS}, s AS (SELECT l.vacancy_id, l.label, {_COS} AS cosine, cast('0x' || substr(md5('judge' || l.vacancy_id), 1, 7) AS integer) % 101 AS judge FROM l JOIN embeddings e ON e.vec_id = l.vacancy_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _scores(spark, d) -> DataFrame:
    """The judge's scores stand for landed responses: digits of md5."""
    judge = F.conv(F.substring(F.md5(F.concat(F.lit("judge"), F.col("vacancy_id").cast("string"))), 1, 7), 16, 10).cast("int") % 101
    return _labels(spark, d).join(_cosines(spark, d), "vacancy_id").select("vacancy_id", "label", "cosine", judge.cast("double").alias("judge"))


def _precision(score: str) -> str:
    return f"SELECT '{score}' AS method, k, avg(CASE WHEN label = 2 THEN 1.0 ELSE 0.0 END) AS precision FROM (SELECT label, row_number() OVER (ORDER BY {score} DESC, vacancy_id) AS r FROM s), (SELECT unnest([5, 10, 20]) AS k) WHERE r <= k GROUP BY k HAVING count(*) = k"


@query(f"WITH {_SCORES} {_precision('cosine')}")
def precision_at_k(spark, d):
    return ranking.benchmark(_scores(spark, d), ["cosine"])


@query(f"WITH {_SCORES} {_precision('cosine')} UNION ALL {_precision('judge')}")
def landed_scores_benchmark(spark, d):
    """The two scores that SQL can express; three_way_benchmark has the fitted one too."""
    return ranking.benchmark(_scores(spark, d), ["cosine", "judge"])


@query(f"WITH {_SCORES} SELECT min(judge) AS low, max(judge) AS high, avg(judge) AS mean, count(DISTINCT judge) AS n_unique, count(judge) AS n FROM s")
def score_spread(spark, d):
    return ranking.score_spread(_scores(spark, d), "judge")


_FOLDS = f"{_LABELS}, f AS (SELECT vacancy_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vacancy_id), vacancy_id) - 1) % 5 AS fold FROM l)"


@query(f"WITH {_FOLDS} SELECT vacancy_id, label, fold FROM f")
def fold_assignment(spark, d):
    return ranking.assign_folds(_labels(spark, d))


@query(f"WITH {_LABELS} SELECT vacancy_id, round(count(*) OVER () / (3.0 * count(*) OVER (PARTITION BY label)), 9) AS weight FROM l")
def class_weights(spark, d):
    return ranking.class_weights(_labels(spark, d)).select("vacancy_id", F.round("weight", 9).alias("weight"))


_METRICS = ", ".join(
    [f"avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy"]
    + [f"coalesce(count(*) FILTER (label = {c} AND prediction = {c}) / nullif(count(*) FILTER ({side} = {c}), 0), 0) AS {name}_{c}" for c in (0, 1, 2) for side, name in (("prediction", "precision"), ("label", "recall"))]
    + [f"coalesce(2.0 * count(*) FILTER (label = {c} AND prediction = {c}) / nullif(count(*) FILTER (prediction = {c}) + count(*) FILTER (label = {c}), 0), 0) AS f1_{c}" for c in (0, 1, 2)]
)
_METRIC_NAMES = ["accuracy", *(f"{m}_{c}" for c in (0, 1, 2) for m in ("precision", "recall", "f1"))]


def _fold_metrics(spark, d) -> DataFrame:
    return ranking.metrics(ranking.assign_folds(_labels(spark, d)).withColumn("prediction", (F.col("vacancy_id") % 3).cast("int")))


@query(f"WITH {_FOLDS}, m AS (SELECT fold, {_METRICS} FROM (SELECT *, vacancy_id % 3 AS prediction FROM f) GROUP BY fold) SELECT fold, {', '.join(f'round({n}, 9) AS {n}' for n in _METRIC_NAMES)} FROM m")
def fold_metrics(spark, d):
    return _fold_metrics(spark, d).select("fold", *(F.round(n, 9).alias(n) for n in _METRIC_NAMES))


@query(f"WITH {_FOLDS}, m AS (SELECT fold, {_METRICS} FROM (SELECT *, vacancy_id % 3 AS prediction FROM f) GROUP BY fold) SELECT {', '.join(f'round(avg({n}), 9) AS {n}_mean, round(stddev_pop({n}), 9) AS {n}_std' for n in _METRIC_NAMES)} FROM m")
def cross_fold_summary(spark, d):
    out = ranking.over_folds(_fold_metrics(spark, d))
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query(f"{WITH} SELECT vacancy_id, list_sort(list_distinct(list_transform({_SKILLS}, lambda x: 'skill:' || x))) AS hot, 'seniority_' || seniority AS seniority_hot, 'remote_' || remote_policy AS remote_hot FROM p")
def multi_hot(spark, d):
    rows = _with_skills(spark, d)
    hot = model.multi_hot(rows, "vacancy_id").groupBy("vacancy_id").agg(F.sort_array(F.collect_list(F.concat(F.lit("skill:"), "skill"))).alias("hot"))  # of one posting
    out = rows.join(hot, "vacancy_id", "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<string>")))
    return out.select("vacancy_id", "hot", F.concat(F.lit("seniority_"), "seniority").alias("seniority_hot"), F.concat(F.lit("remote_"), "remote_policy").alias("remote_hot"))


@query(f"{WITH} SELECT skill, (row_number() OVER (ORDER BY skill) - 1)::BIGINT AS ordinal FROM (SELECT skill FROM (SELECT unnest([skill_a, title, url]) AS skill FROM p) GROUP BY skill)")
def skill_ordinals(spark, d):
    """Places in a sorted vocabulary that is as long as the table."""
    named = synth.postings(spark, d).select(F.explode(F.array("skill_a", "title", "url")).alias("skill"))
    return model.ordinals(named, "skill")


STOP = ("the", "and", "of", "to", "in", "for", "with", "new")
_TERMS = r"list_filter(regexp_extract_all(lower(title), '[\p{L}\p{N}_]{2,}'), lambda w: NOT list_contains([" + _quoted(STOP) + "], w))"


@query(f"{WITH}, w AS (SELECT vacancy_id, {_TERMS} AS w FROM p), t AS (SELECT vacancy_id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM w), v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM p)) / (1.0 + count(DISTINCT vacancy_id))) + 1 AS idf FROM t GROUP BY term ORDER BY count(*) DESC, term LIMIT 150), e AS (SELECT vacancy_id, term, count(*) * max(idf) AS x FROM t JOIN v USING (term) GROUP BY vacancy_id, term) SELECT vacancy_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY vacancy_id)), 9) AS weight FROM e")
def title_tfidf(spark, d):
    rows = synth.postings(spark, d).select("vacancy_id", "title")
    return model.tfidf(rows, model.tfidf_vocabulary(rows, STOP), "vacancy_id", STOP).select("vacancy_id", "term", F.round("weight", 9).alias("weight"))


_FOLD_TERMS = (
    f"{WITH}, {_FOLDS}, w AS (SELECT vacancy_id, fold, {_TERMS} AS w FROM p JOIN f USING (vacancy_id)), t AS (SELECT vacancy_id, fold, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM w), "
    "k AS (SELECT unnest(range(5)) AS without), c AS (SELECT without, term, count(*) AS n, count(DISTINCT vacancy_id) AS df FROM t JOIN k ON fold <> without GROUP BY without, term QUALIFY row_number() OVER (PARTITION BY without ORDER BY n DESC, term) <= 150), "
    f"s AS (SELECT without, skill AS term, count(*) AS n FROM (SELECT fold, unnest({_SKILLS}) AS skill FROM p JOIN f USING (vacancy_id)) JOIN k ON fold <> without GROUP BY ALL HAVING count(*) >= 3), "
    "o AS (SELECT DISTINCT without, kind, term FROM (SELECT fold, unnest(['seniority', 'remote']) AS kind, unnest([seniority, remote_policy]) AS term FROM p JOIN f USING (vacancy_id)) JOIN k ON fold <> without) "
    "SELECT without::INTEGER AS without, 'term' AS kind, term, round(ln((1.0 + (SELECT count(*) FROM f WHERE fold <> without)) / (1.0 + df)) + 1, 9) AS idf FROM c UNION ALL SELECT without::INTEGER, 'skill', term, 1.0 FROM s UNION ALL SELECT without::INTEGER, kind, term, 1.0 FROM o"
)


@query(_FOLD_TERMS)
def fold_vocabularies(spark, d):
    """What the model of each fold knows, from one count of all names by fold."""
    rows = _labels(spark, d).join(_with_skills(spark, d), "vacancy_id")
    return model.fold_vocabularies(ranking.assign_folds(rows.select("vacancy_id", "label", "title", "skills", "seniority", "remote_policy")), 5, STOP).withColumn("idf", F.round("idf", 9))


def _response(kind: str, broken: Column) -> Column:
    salary = F.when(F.col("salary") != "", F.col("salary"))
    content = F.to_json(F.struct(F.col("phrase").alias("summary"), F.from_json("skills_json", "array<string>").alias("skills"), "seniority", salary.alias("salary_min"), F.lit(0).alias("salary_max"), F.col("currency").alias("salary_currency"), F.when(F.col("vacancy_id") % 2 == 0, F.lit("yearly")).alias("salary_period"), "language_requirement", F.col("remote_policy")))
    content = F.when(broken, F.lit("not JSON")).otherwise(content)
    if kind == "gemini":
        return F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(content.alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    return F.to_json(F.struct(F.struct(content.alias("content")).alias("message")))


@query(f"{WITH} SELECT vacancy_id, '[\"' || skill_a || '\",\"' || skill_b || '\"]' AS skills_json FROM p")
def skills_serialized(spark, d):
    return _with_skills(spark, d).select("vacancy_id", parse.serialize_skills(F.col("skills")).alias("skills_json"))


@query(f"{WITH} SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN vacancy_id % 12 = 0 THEN 'failed' ELSE 'succeeded' END AS outcome FROM p) GROUP BY outcome")
def extraction_run_counts(spark, d):
    p = synth.postings(spark, d)
    outcome = F.when(_two_providers().isNull(), "failed").otherwise("succeeded").alias("outcome")
    return p.groupBy(outcome).agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT vacancy_id, CASE WHEN title IS NOT NULL THEN cast('0x' || substr(md5(title), 1, 7) AS integer) % 101 END AS fit_score FROM p")
def judge_by_client(spark, d):
    """A client on the executors; this one computes its answers."""

    def client(prompts):
        return [json.dumps({"message": {"content": json.dumps({"fit_score": int(hashlib.md5(x.encode()).hexdigest()[:7], 16) % 101})}}) for x in prompts]

    asked = clients.ask(synth.postings(spark, d).select("vacancy_id", "title"), "title", client)
    return asked.select("vacancy_id", parse.fit_score(F.col("response")).alias("fit_score"))


def _md5(prompt: str) -> int:
    return int(hashlib.md5(prompt.encode()).hexdigest()[:7], 16)


_ASKED = f"{WITH}, a AS (SELECT vacancy_id, concat(cast(vacancy_id AS varchar), ':', title) AS prompt, cast('0x' || substr(md5(concat(cast(vacancy_id AS varchar), ':', title)), 1, 7) AS integer) AS h FROM p)"


@query(
    f"{_ASKED} SELECT vacancy_id, CASE WHEN h % 4 <> 0 THEN 'first' WHEN h % 3 <> 0 THEN 'second' END AS provider, CASE WHEN h % 4 <> 0 THEN 'first' ELSE 'first,second' END AS asked, "
    "CASE WHEN h % 4 = 0 AND h % 3 = 0 THEN 'second: OSError: https://model.example.com/v1?[redacted] is busy' END AS error, CASE WHEN h % 12 <> 0 THEN h % 101 END AS fit_score FROM a"
)
def client_chain(spark, d):
    """Two providers: the second is asked only for what the first failed. They compute their answers."""

    def first(prompts, key):
        return [json.dumps({"fit_score": _md5(x) % 101}) if _md5(x) % 4 else "not JSON" for x in prompts]

    def second(prompts):
        if _md5(prompts[0]) % 3 == 0:
            raise OSError("https://model.example.com/v1?key=1 is busy")
        return [json.dumps({"fit_score": _md5(x) % 101}) for x in prompts]

    providers = [clients.Provider("first", first, keys=("a", "b", "c")), clients.Provider("second", second, batch=1, timeout=60)]
    rows = synth.postings(spark, d).select("vacancy_id", F.concat(F.col("vacancy_id").cast("string"), F.lit(":"), "title").alias("prompt"))
    out = clients.ask_chain(rows, "prompt", providers, valid=lambda x: x.startswith("{"))
    return out.select("vacancy_id", "provider", F.array_join("asked", ",").alias("asked"), "error", F.get_json_object("response", "$.fit_score").cast("int").alias("fit_score"))


@query(f"{_ASKED} SELECT vacancy_id, CASE WHEN h % 5 <> 0 THEN 2 END AS size, CASE WHEN h % 5 <> 0 THEN cast(h % 7 AS float) END AS x, CASE WHEN h % 5 <> 0 THEN cast(length(prompt) AS float) END AS y FROM a")
def client_embeddings(spark, d):
    """Vectors of an embedding client; it has none for some."""
    provider = clients.Provider("embedder", lambda prompts: [[_md5(x) % 7, len(x)] if _md5(x) % 5 else None for x in prompts], batch=64)
    rows = synth.postings(spark, d).select("vacancy_id", F.concat(F.col("vacancy_id").cast("string"), F.lit(":"), "title").alias("prompt"))
    out = clients.embed(rows, "prompt", provider)
    return out.select("vacancy_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("size"), F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))


_ODD = '{"salary_min": 60000.0, "salary_max": "70000", "seniority": ["x"], "summary": {"a": 1}, "salary_currency": "EUR"}'


@query(f"{WITH} SELECT vacancy_id, 60000 AS salary_min, 70000 AS salary_max, '' AS seniority, NULL::varchar AS summary, 'EUR' AS salary_currency, 87 AS fit_score FROM p")
def extraction_number_forms(spark, d):
    """Numbers with fractions or as texts, objects and arrays in the place of texts."""
    p = synth.postings(spark, d)
    content = F.get_json_object(F.to_json(F.struct(F.struct(F.when(F.col("vacancy_id").isNotNull(), F.lit(_ODD)).alias("content")).alias("message"))), "$.message.content")
    judged = F.when(F.col("vacancy_id").isNotNull(), F.lit(json.dumps({"message": {"content": '{"fit_score": 87.5}'}})))
    return p.select("vacancy_id", parse.extraction(content, "m").alias("x"), parse.fit_score(judged).alias("fit_score")).select("vacancy_id", "x.salary_min", "x.salary_max", "x.seniority", "x.summary", "x.salary_currency", "fit_score")


_FIELDS = "phrase AS summary, seniority, CASE WHEN salary IN ('2800', '60000') THEN cast(salary AS integer) END AS salary_min, CASE WHEN salary IN ('2800', '60000') AND currency <> '' THEN currency END AS salary_currency, CASE WHEN vacancy_id % 2 = 0 THEN 'yearly' ELSE 'unknown' END AS salary_period, CASE WHEN language_requirement <> '' THEN language_requirement END AS language_requirement"


@query(f"{WITH} SELECT vacancy_id, {_FIELDS}, len({_SKILLS}) AS n_skills FROM p")
def extraction_normalize(spark, d):
    p = synth.postings(spark, d).withColumn("response", _response("gemini", F.lit(False)))
    x = p.select("vacancy_id", parse.extraction(parse.gemini_content(F.col("response")), "gemini").alias("x")).select("vacancy_id", "x.*")
    return x.select("vacancy_id", "summary", "seniority", "salary_min", "salary_currency", "salary_period", "language_requirement", F.size("skills").alias("n_skills"))


@query(f"{WITH} SELECT vacancy_id, seniority, CASE WHEN vacancy_id % 4 = 0 THEN 'ollama' ELSE 'gemini' END AS extraction_model FROM p WHERE vacancy_id % 12 <> 0")
def extraction_fallback(spark, d):
    p = synth.postings(spark, d)
    return p.select("vacancy_id", _two_providers().alias("x")).where("x IS NOT NULL").select("vacancy_id", "x.seniority", "x.extraction_model")


def _two_providers() -> Column:
    first = parse.extraction(parse.gemini_content(_response("gemini", F.col("vacancy_id") % 4 == 0)), "gemini")
    second = parse.extraction(parse.ollama_content(_response("ollama", F.col("vacancy_id") % 3 == 0)), "ollama")
    return parse.with_fallback(first, second)


@query(f"{WITH} SELECT vacancy_id, CASE WHEN vacancy_id % 3 <> 0 THEN vacancy_id % 101 END AS fit_score FROM p")
def judge_scores(spark, d):
    answer = F.when(F.col("vacancy_id") % 3 == 0, F.lit("{}")).otherwise(F.to_json(F.struct((F.col("vacancy_id") % 101).alias("fit_score"))))
    response = F.to_json(F.struct(F.struct(answer.alias("content")).alias("message")))
    return synth.postings(spark, d).select("vacancy_id", parse.fit_score(response).alias("fit_score"))


@query(f"{WITH} SELECT vacancy_id, skill_a || ', ' || skill_b AS skills, CASE WHEN salary IN ('2800', '60000') THEN salary || '-None ' || currency || ' (yearly)' ELSE '—' END AS salary, length(concat('Rate: ', substr(body, 1, 6000), '.')) AS n_prompt FROM p")
def display_and_prompt(spark, d):
    low = parse.positive_int(F.col("salary"))
    shown = T.display_salary(low, F.lit(None).cast("int"), F.col("currency"), F.lit("yearly"))
    return _with_skills(spark, d).select("vacancy_id", T.display_skills(F.col("skills")).alias("skills"), shown.alias("salary"), F.length(T.prompt(F.col("body"), "Rate: ", ".")).alias("n_prompt"))


_PROMPT_TEXT = "substr(body, 1, 6000)"
_JUDGED = "'You rate how well a job posting fits a person.' || chr(10) || chr(10) || 'The person:' || chr(10) || skill_a || ' and {posting}' || chr(10) || chr(10) || 'The posting:' || chr(10) || " + _PROMPT_TEXT + " || chr(10) || chr(10) || 'Answer with JSON: fit_score, a whole number from 0 (no fit) to 100 (perfect).'"
_EXTRACTED = "'Read the job posting and answer with JSON that has these fields: summary, skills. Use 0 or an empty text where the posting says nothing, and ''unknown'' for seniority, salary_period and remote_policy.' || chr(10) || chr(10) || " + _PROMPT_TEXT


@query(f"{WITH} SELECT vacancy_id, {_JUDGED} AS judge, {_EXTRACTED} AS extract FROM p")
def prompts(spark, d):
    """Both prompts in full; a profile's own braces stay as they are."""
    person = F.concat("skill_a", F.lit(" and {posting}"))
    return synth.postings(spark, d).select("vacancy_id", T.judge_prompt(F.col("body"), person).alias("judge"), T.extraction_prompt(F.col("body"), "summary, skills").alias("extract"))


_EXTRACTION = ("summary", "skills", "seniority", "salary_min", "salary_max", "salary_currency", "salary_period", "language_requirement", "remote_policy", "extraction_model")


@query(
    f"{WITH} SELECT vacancy_id, phrase AS summary, '[\"' || skill_a || '\",\"' || skill_b || '\"]' AS skills, seniority, CASE WHEN salary IN ('2800', '60000') THEN cast(salary AS integer) END AS salary_min, NULL::integer AS salary_max, "
    "CASE WHEN salary IN ('2800', '60000') AND currency <> '' THEN currency END AS salary_currency, CASE WHEN vacancy_id % 2 = 0 THEN 'yearly' ELSE 'unknown' END AS salary_period, CASE WHEN language_requirement <> '' THEN language_requirement END AS language_requirement, remote_policy, "
    "CASE WHEN vacancy_id % 3 = 0 THEN 'second' ELSE 'first' END AS extraction_model, CASE WHEN vacancy_id % 3 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS extracted_at FROM p"
)
def upsert_extraction_rows(spark, d):
    """Whole extractions: a third of the postings was extracted again, by another model."""
    p = synth.postings(spark, d).withColumn("response", _response("gemini", F.lit(False)))

    def run(rows, model_name, day):
        x = rows.select("vacancy_id", parse.extraction(parse.gemini_content(F.col("response")), model_name).alias("x"))
        return x.select("vacancy_id", *(F.col(f"x.{c}").alias(c) for c in _EXTRACTION), F.lit(day).cast("timestamp_ntz").alias("extracted_at"))

    out = state.upsert_by_key(run(p, "first", "2024-01-01"), run(p.where("vacancy_id % 3 = 0"), "second", "2024-02-01"), "vacancy_id", ["extracted_at"])
    return out.withColumn("skills", parse.serialize_skills(F.col("skills")))


def _model_rows(spark, d) -> DataFrame:
    rows = _with_skills(spark, d).where(~rules.requires_other_language(F.col("language_requirement")))
    return _labels(spark, d).join(rows, "vacancy_id").select("vacancy_id", "label", "title", "skills", "seniority", "remote_policy")


@query(None)
def oof_expected_rating(spark, d):
    """A fitted model is not expressible in SQL; tests hold the fit of each fold against a NumPy solution."""
    return model.out_of_fold(_model_rows(spark, d)).select("vacancy_id", "label", "fold", "prediction", F.round("rating", 6).alias("rating"))


@query(None)
def three_way_benchmark(spark, d):
    """Out-of-fold rating, judge and cosine over the same labelled rows that need no other language than English; a missing cosine
    counts as 0. A fitted model is not expressible in SQL; the other two scores are, in landed_scores_benchmark."""
    rated = model.out_of_fold(_model_rows(spark, d)).select("vacancy_id", "label", "rating")
    both = rated.join(_scores(spark, d).select("vacancy_id", "cosine", "judge"), "vacancy_id", "left").fillna({"cosine": 0.0, "judge": 0.0})
    return ranking.benchmark(both, ["rating", "judge", "cosine"])


@query("SELECT source AS origin, unnest(generate_series(0, count(*) - 1, 20)) AS page_offset FROM documents GROUP BY source")
def listing_pages(spark, d):
    sizes = _table(spark, d, "documents").groupBy(F.col("source").alias("origin")).agg(F.count("*").cast("int").alias("total"))
    return sizes.select("origin", F.explode(src.page_offsets(F.col("total"), 20).cast("array<bigint>")).alias("page_offset"))


@query(f"{WITH} SELECT origin AS company, title, url AS external_path FROM p WHERE vacancy_id % 4 <> 0")
def workday_listing(spark, d):
    # Two entries a page; the paths of some are missing or null.
    p = synth.postings(spark, d)
    entry = F.struct("title", F.when(F.col("vacancy_id") % 4 != 0, F.col("url")).alias("externalPath"))
    pages = p.select(F.col("origin").alias("company"), F.to_json(F.struct(F.lit(2).alias("total"), F.array(entry, F.struct(F.lit("No path").alias("title"), F.lit(None).cast("string").alias("externalPath"))).alias("jobPostings"))).alias("payload"))
    return src.workday_listing(pages)


@query(f"{WITH} SELECT origin AS company, title, url AS external_path FROM p WHERE vacancy_id % 4 <> 0 AND origin <> ''")
def paged_listing(spark, d):
    """Listings of some twenty entries a page, landed page by page and asked for by the paged source."""
    p = synth.postings(spark, d).where("origin <> ''")
    sizes = p.groupBy("origin").agg(F.count("*").cast("int").alias("total"))
    # How many entries a page has differs; a listing has as many pages as its length takes.
    page = F.pmod(F.xxhash64("vacancy_id"), F.ceil(F.col("total") / 20)).cast("int") * 20
    entry = F.struct("title", F.when(F.col("vacancy_id") % 4 != 0, F.col("url")).alias("externalPath"))
    pages = p.join(sizes, "origin").groupBy(F.col("origin").alias("company"), "total", page.alias("page_offset")).agg(F.collect_list(entry).alias("jobPostings"))  # some twenty
    at = scratch(spark, "listing")
    every = sizes.select(F.col("origin").alias("company"), "total", F.explode(src.page_offsets(F.col("total"), 20)).alias("page_offset"))
    filled = every.join(pages.drop("total"), ["company", "page_offset"], "left")
    filled.select("company", "page_offset", F.to_json(F.struct("total", "jobPostings")).alias("value")).write.partitionBy("company", "page_offset").text(at)
    companies = [r.origin for r in sizes.select("origin").collect()]  # a row a board
    landed = paged.listing(spark, companies, url=f"{at}/company={{company}}/page_offset={{offset}}", fetcher="jobweave.sources.paged:FolderFetcher", pagesize=20, mindelay=0, maxdelay=0, pagespertask=20)
    return src.workday_listing(landed.select("company", "payload"))


@query(f"{WITH} SELECT vacancy_id, list_transform(string_split(language_requirement, ','), lambda x: trim(x)) AS languages FROM p")
def page_languages(spark, d):
    spans = F.array_join(F.transform(F.split("language_requirement", ","), lambda x: F.concat(F.lit("<div><span>"), x, F.lit("</span><span>fluent</span></div>"))), "")
    page = F.concat(F.lit('<body><div data-testid="languages"><div>Languages</div><div>'), spans, F.lit("</div></div></body>"))
    return synth.postings(spark, d).select("vacancy_id", T.required_languages(page).alias("languages"))


_SOURCES = ("workday", "greenhouse", "ashby", "lever", "smartrecruiters", "magnetme")


@query(
    f"{WITH}, c AS (SELECT count(*) AS n, count(*) FILTER (level NOT IN ({_quoted(rules.EXCLUDED_LEVELS)})) AS kept FROM p) "
    f"SELECT s AS source, CASE WHEN s = 'smartrecruiters' THEN kept ELSE n END AS n FROM c, (SELECT unnest([{_quoted(_SOURCES)}]) AS s)"
)
def all_sources(spark, d):
    boards = [source_projection_workday, source_projection_greenhouse, source_projection_ashby, source_projection_lever, source_projection_smartrecruiters, json_ld_posting]
    named = [f(spark, d).select(F.lit(s).alias("source"), "url", "title") for s, f in zip(_SOURCES, boards, strict=True)]
    return src.all_postings(*named).groupBy("source").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT vacancy_id % 7 <> 0 AND vacancy_id % 5 <> 0 AS accepted, count(*) AS n FROM p GROUP BY ALL")
def posting_quarantine(spark, d):
    missing = lambda name, k: F.when(F.col("vacancy_id") % k != 0, F.col(name)).alias(name)
    ok, held = src.quarantine(synth.postings(spark, d).select("source", missing("url", 7), missing("title", 5)))
    both = ok.withColumn("accepted", F.lit(True)).unionByName(held.withColumn("accepted", F.lit(False)))
    return both.groupBy("accepted").agg(F.count("*").alias("n"))


@query(f"WITH {_LABELS} SELECT vacancy_id, label FROM l")
def insert_labels(spark, d):
    labels = _labels(spark, d)
    return state.insert_labels(labels.where("vacancy_id % 5 <> 0"), labels.where("vacancy_id % 5 = 0")).select("vacancy_id", "label")


@query(f"WITH {_LABELS} SELECT label, round(count(*) / (SELECT count(*) FROM l), 9) AS share FROM l GROUP BY label")
def label_shares(spark, d):
    return ranking.label_shares(_labels(spark, d)).select("label", F.round("share", 9).alias("share"))


@query("SELECT cast(event_id % 3 AS integer) AS slot, count(*) AS n FROM events GROUP BY ALL")
def round_robin_calls(spark, d):
    return _table(spark, d, "events").groupBy(ranking.round_robin(F.col("event_id"), 3).alias("slot")).agg(F.count("*").alias("n"))


@query(f"WITH {_LABELS} SELECT vacancy_id, label, NULL::varchar AS note FROM l")
def evolved_labels(spark, d):
    return state.evolve(_labels(spark, d), {"note": "string"})


@query(None)
def coefficient_axis(spark, d):
    """Features that speak most for label 2 over label 0, and most against; a fitted model is not expressible in SQL."""
    rows = _model_rows(spark, d).cache()
    features = model.Features.fit(rows)
    fitted = model.fit_model(rows, features)
    rows.unpersist()
    return model.coefficient_axis(fitted, features).select("feature", F.round("axis", 4).alias("axis"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 labelled postings nearest to the profile, without those that require another language, and precision@k so far."""
    kept = synth.postings(spark, sf_dir).where(~rules.requires_other_language(F.col("language_requirement"))).select("vacancy_id", "title", "source")
    best = ranking.top_k(_scores(spark, sf_dir).join(kept, "vacancy_id"), "cosine", "vacancy_id", 20)
    from pyspark.sql import Window

    place = Window.orderBy(F.col("cosine").desc(), "vacancy_id")  # over the 20 rows only
    best = best.withColumn("place", F.row_number().over(place))
    return best.withColumn("precision_so_far", F.avg((F.col("label") == 2).cast("double")).over(place)).select("place", "vacancy_id", "title", "source", "cosine", "label", "precision_so_far")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
