"""Text functions on columns: HTML, entities, JSON-LD, descriptions, display."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .markup import JAVA_SPACE, html_texts, html_to_text, json_scripts, unescape  # noqa: F401

#: Word boundary with an ASCII idea of words, whatever the JDK's is.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def pattern(regex: str) -> str:
    """A case-insensitive pattern whose \\b is ASCII."""
    return "(?i)" + regex.replace(r"\b", BOUNDARY)


def strip(x: Column, space: str = JAVA_SPACE) -> Column:
    """Without white space at both ends."""
    return F.btrim(x, F.lit(space))


def blank_to_null(x: Column) -> Column:
    """Null where nothing but white space; other values stay untrimmed."""
    return F.when(strip(x) != "", x)


def json_ld(x: Column, kind: str = "JobPosting") -> Column:
    """The first JSON-LD block of that @type, as JSON text, or null; blocks that don't parse are passed over."""
    blocks = json_scripts(x)
    return F.try_element_at(F.filter(blocks, lambda b: F.coalesce(F.get_json_object(b, "$['@type']") == kind, F.lit(False))), F.lit(1))


def _languages_of(page: str) -> list[str]:
    from html.parser import HTMLParser

    class Box(HTMLParser):
        """Second div child of the language box; the first span's text of each of its children."""

        def __init__(self):
            super().__init__()
            self.depth, self.box, self.divs, self.child, self.span, self.found, self.done = 0, None, 0, None, False, [], False

        def handle_starttag(self, tag, attrs):
            if tag in ("br", "img", "input", "meta", "link", "hr"):
                return
            self.depth += 1
            if self.box is None and not self.done and dict(attrs).get("data-testid") == "languages":
                self.box = self.depth
            elif self.box is not None:
                level = self.depth - self.box
                if level == 1:
                    self.divs += tag == "div"
                    self.second = tag == "div" and self.divs == 2
                elif level == 2 and self.second:
                    self.child = "open"
                if level >= 2 and self.second and tag == "span" and self.child == "open":
                    self.child, self.span, self.text, self.at = "taken", True, "", self.depth

        def handle_endtag(self, tag):
            if self.box is not None:
                if self.span and self.depth == self.at:
                    self.span = False
                    self.found.append(self.text.strip())
                if self.depth == self.box:
                    self.box, self.done = None, True
            self.depth -= 1

        def handle_data(self, data):
            if self.box is not None and self.span:
                self.text += data

    parser = Box()
    parser.feed(page or "")
    return parser.found


@F.pandas_udf(ArrayType(StringType()))
def required_languages(x: pd.Series) -> pd.Series:
    """Languages of a page's language box; without the box, or with fewer than two parts in it, none."""
    return x.map(_languages_of)


def merge_descriptions(parts: Column) -> Column:
    """Folds overlapping texts: each is stripped; one that is contained in a kept text is left out, kept ones that it contains go."""
    texts = F.filter(F.transform(parts, lambda p: strip(F.coalesce(p, F.lit("")))), lambda p: p != "")
    step = lambda kept, p: F.when(F.exists(kept, lambda k: F.contains(k, p)), kept).otherwise(F.concat(F.filter(kept, lambda k: ~F.contains(p, k)), F.array(p)))
    return F.array_join(F.aggregate(texts, F.array().cast("array<string>"), step), "\n\n")


def list_sections(lists: Column) -> Column:
    """array<struct<text, content>> as 'heading\\ntext' sections; blank contents are left out, blank headings too."""
    bodies = html_texts(F.transform(lists, lambda x: F.coalesce(x["content"], F.lit(""))))
    cut = F.zip_with(lists, bodies, lambda x, body: F.struct(strip(F.coalesce(x["text"], F.lit(""))).alias("head"), body.alias("body")))
    return F.array_join(F.transform(F.filter(cut, lambda x: x["body"] != ""), lambda x: F.when(x["head"] == "", x["body"]).otherwise(F.concat(x["head"], F.lit("\n"), x["body"]))), "\n\n")


def join_location(locality: Column, country: Column) -> Column:
    """'locality, country' without blank parts; null if both are blank."""
    return F.nullif(F.concat_ws(", ", blank_to_null(locality), blank_to_null(country)), F.lit(""))


def redact_query(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)\?.*$", "?[redacted]")


def display_salary(low: Column, high: Column, currency: Column, period: Column) -> Column:
    shown = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    return F.when(low.isNull(), F.lit("—")).otherwise(F.concat(shown(low), F.lit("-"), shown(high), F.lit(" "), F.coalesce(currency, F.lit("")), F.lit(" ("), shown(period), F.lit(")")))


def display_skills(skills: Column) -> Column:
    return F.when(F.coalesce(F.size(skills), F.lit(0)) > 0, F.array_join(skills, ", ")).otherwise("(none extracted)")


def fill(template: str, **values: Column | str) -> Column:
    """A template with {names}, each replaced by its value (null: nothing)."""
    parts = re.split(r"\{(\w+)\}", template)
    shown = [F.lit(p) if k % 2 == 0 else values[p] if isinstance(values[p], Column) else F.lit(values[p]) for k, p in enumerate(parts)]
    return F.concat(*(F.coalesce(x, F.lit("")) for x in shown))


JUDGE = "You rate how well a job posting fits a person.\n\nThe person:\n{profile}\n\nThe posting:\n{posting}\n\nAnswer with JSON: fit_score, a whole number from 0 (no fit) to 100 (perfect)."
EXTRACT = "Read the job posting and answer with JSON that has these fields: {fields}. Use 0 or an empty text where the posting says nothing, and 'unknown' for seniority, salary_period and remote_policy.\n\n{posting}"


def judge_prompt(raw_text: Column, profile: Column | str, template: str = JUDGE, limit: int = 6000) -> Column:
    return fill(template, profile=profile, posting=F.substring(raw_text, 1, limit))


def extraction_prompt(raw_text: Column, fields: str, template: str = EXTRACT, limit: int = 6000) -> Column:
    return fill(template, fields=fields, posting=F.substring(raw_text, 1, limit))


def prompt(raw_text: Column, before: str, after: str = "", limit: int = 6000) -> Column:
    """Fixed text around the first `limit` characters of a posting."""
    return F.concat(F.lit(before), F.substring(raw_text, 1, limit), F.lit(after))
