"""HTML in Arrow batches: a tokenizer after the states of the HTML standard, and what is made of its tokens.

One pass over a text, one compiled pattern a state, no tree: text nodes, tags with their attributes, and the contents of elements
whose contents are no markup. Elements are not moved (text inside a table, but outside its cells, stays where it stands).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space of Java's strip (no-break spaces are none) and of Python's.
JAVA_SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f               　"
PYTHON_SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0                　"

# Names and values as the tokenizer's states cut them. Everything is possessive: where a tag isn't closed, nothing else matches.
_ATTRIBUTE = r"""([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?=>)|[^\t\n\f\r >"'][^\t\n\f\r >]*+|\Z))?+"""
_TAG = re.compile(r"<(/?+)([A-Za-z][^\t\n\f\r />]*+)((?:[\t\n\f\r /]++|" + _ATTRIBUTE.replace("(", "(?:", 1).replace('("', '(?:"') + r")*+)>")
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.DOTALL)
_MARKUP = re.compile(r"<(?=[A-Za-z/!?])")
#: Elements whose contents are no markup: neither text, text with references, text as it stands.
HIDDEN, REFERENCES, VERBATIM = ("script", "style"), ("textarea", "title"), ("xmp", "iframe", "noembed", "noframes")
_ENDS = {name: re.compile(rf"</{name}(?=[\t\n\f\r />])", re.IGNORECASE) for name in (*HIDDEN, *REFERENCES, *VERBATIM)}

Token = tuple[str, str, str]


def tokens(page: str) -> Iterator[Token]:
    """(kind, value, attributes): text (decoded), hidden (what stands in scripts and styles), start and end (lower-case names). A
    start tag's attributes are uncut, see attributes(). A tag that the page doesn't close goes, with all that follows."""
    at = begin = 0
    while True:
        found = _MARKUP.search(page, at)
        if not found:
            break
        at = found.start()
        after = page[at + 1]
        end_of = None
        if after.isalpha() or (after == "/" and page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha()):
            tag = _TAG.match(page, at)
            if begin < at:
                yield "text", html.unescape(page[begin:at]), ""
            if not tag:
                return
            name = tag[2].lower()
            yield ("end" if tag[1] else "start"), name, tag[3]
            begin = at = tag.end()
            if tag[1]:
                continue
            if name == "plaintext":
                yield "text", page[begin:], ""
                return
            if end_of := _ENDS.get(name):
                end = end_of.search(page, at)
                begin = at = end.start() if end else len(page)
                inside = page[tag.end() : at]
                if inside:
                    yield ("hidden" if name in HIDDEN else "text"), html.unescape(inside) if name in REFERENCES else inside, ""
            continue
        if after == "/" and at + 2 >= len(page):
            break  # "</" at the end is text
        if begin < at:
            yield "text", html.unescape(page[begin:at]), ""
        if page.startswith("<!--", at):
            at = _COMMENT.match(page, at).end()
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            inside = page[at + 9 : end if end >= 0 else len(page)]
            if inside:
                yield "text", inside, ""
            at = end + 3 if end >= 0 else len(page)
        else:
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
        begin = at
    if begin < len(page):
        yield "text", html.unescape(page[begin:]), ""


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a start tag, names in lower case; of equal names the first counts."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTES.findall(raw):
        if value[:1] in ('"', "'"):
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value))
    return out


def text_of(page: str | None) -> str | None:
    """Text nodes in document order, joined by line feeds, stripped; white space inside is kept."""
    return None if page is None else "\n".join(v for kind, v, _ in tokens(page) if kind == "text" and v).strip(JAVA_SPACE)


def scripts_of(page: str | None, kind: str) -> list[str]:
    """Contents of a page's scripts of that type."""
    out, wanted = [], False
    for token, value, raw in tokens(page or ""):
        if token == "hidden" and wanted:
            out.append(value)
        wanted = token == "start" and value == "script" and attributes(raw).get("type", "").strip().lower() == kind
    return out


@F.pandas_udf(StringType())
def html_to_text(x: pd.Series) -> pd.Series:
    """A column of HTML as text, see text_of. Null stays null."""
    return x.map(text_of)


@F.pandas_udf(ArrayType(StringType()))
def html_texts(x: pd.Series) -> pd.Series:
    """html_to_text of each of an array."""
    return x.map(lambda pages: None if pages is None else [text_of(p) for p in pages])


@F.pandas_udf(StringType())
def _unescape(x: pd.Series) -> pd.Series:
    return x.map(html.unescape, na_action="ignore")


def unescape(x: Column) -> Column:
    """Decodes every HTML5 entity and character reference, once."""
    return _unescape(x)


@F.pandas_udf(ArrayType(StringType()))
def json_scripts(x: pd.Series) -> pd.Series:
    """Contents of the JSON-LD scripts of a page."""
    return x.map(lambda page: scripts_of(page, "application/ld+json"))
