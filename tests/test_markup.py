import glob
import html
import os
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobweave.functions import markup


class Walk(HTMLParser):
    """Text nodes by the standard library's parser; each of its calls for one run of text is joined."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.parts, self.open, self.hidden = [], False, 0

    def cut(self, *_):
        self.open = False

    def handle_starttag(self, tag, attrs):
        self.cut()
        self.hidden = tag in ("script", "style")

    handle_comment = handle_decl = handle_pi = unknown_decl = cut

    def handle_endtag(self, tag):
        self.cut()
        self.hidden = False

    def handle_data(self, data):
        if self.hidden:
            return
        if not self.open:
            self.parts.append("")
            self.open = True
        self.parts[-1] += data

    def handle_entityref(self, name):
        self.handle_data(f"&{name}")

    def handle_charref(self, name):
        self.handle_data(f"&#{name}")


def walked(page):
    parser = Walk()
    # References stay as they stand, with their semicolons, and are decoded afterwards.
    parser.feed(page.replace("&", "\x00"))
    parser.close()
    return "\n".join(html.unescape(p.replace("\x00", "&")) for p in parser.parts).strip(markup.JAVA_SPACE)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_equals_a_parser_on_all_pages(spark, sf):
    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("html", markup.html_to_text("html").alias("t")).collect()
    assert rows and all(r.t == (None if r.html is None else walked(r.html)) for r in rows)


CASES = [
    ('<p title="a > b">Hi</p>', "Hi"),
    ("<p title='\"a\" > b' x=\"'>\">Hi</p>", "Hi"),
    ('<p a=b"c>q"d</p>', 'q"d'),  # a quote inside a bare value opens nothing
    ("<p =x>a<p/ a>b<br/>c", "a\nb\nc"),
    ("a < b <3 <é>", "a < b <3 <é>"),
    ("x<b", "x"),
    ('x<b title="never closed>y</b>z', "x"),
    ("a</>b</ x>c<?php d?>e<!DOCTYPE html>f<!x>g", "a\nb\nc\ne\nf\ng"),
    ("a<!-- <!-- b --> c --> d", "a\n c --> d"),
    ("1<!-->2<!--->3<!-- x --!>4<!-- y", "1\n2\n3\n4"),
    ("<script>if (a<b) '</p>' <!-- </script >k<style>x</STYLE>l", "k\nl"),
    ("<script>never closed", ""),
    ("<textarea><i>x &amp; y</i></textarea>z<title>&lt;</title>", "<i>x & y</i>\nz\n<"),
    ("1<xmp>&lt;<b></xmp>2<iframe>3</iframe>", "1\n&lt;<b>\n2\n3"),
    ("a<plaintext>b<i>&amp;", "a\nb<i>&amp;"),
    ("a<![CDATA[ b>&amp; ]]>c", "a\n b>&amp; \nc"),
    ("&notit; &copy2024 &amp;lt; x&y", html.unescape("&notit; &copy2024 &amp;lt; x&y")),
    ("&am<b></b>p;", "&am\np;"),  # a reference ends with its text
    ("</", "</"),
    ("  x  ", "  x"),
    ("", ""),
]


def test_adversarial(spark):
    rows = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate([*CASES, (None, None)])], "i int, page string, expected string").select("page", "expected", markup.html_to_text("page").alias("t")).collect()
    for r in rows:
        assert r.t == r.expected, r.page
    arrays = spark.createDataFrame([([p for p, _ in CASES],), ([None],), (None,)], "x array<string>").select(markup.html_texts("x").alias("t")).collect()
    assert [r.t for r in arrays] == [[t for _, t in CASES], [None], None]


def test_attributes_and_scripts():
    assert markup.attributes(" A=\"1\" b='2' c=3 d e= f=\" &lt;\" a=9 /") == {"a": "1", "b": "2", "c": "3", "d": "", "e": 'f="', '&lt;"': ""}
    page = "<script type='APPLICATION/ld+json' x='>'>1</script><script>2</script><!-- <script type=application/ld+json>3</script> --><script type=application/ld+json></script><script type=application/ld+json>4"
    assert markup.scripts_of(page, "application/ld+json") == ["1", "4"]
    assert markup.scripts_of(None, "x") == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "/", "!", "--", "'", '"', "=", "a", "script", "title", " ", "&amp;", "x", "?", "\n"]), max_size=40).map("".join))
def test_any_text_is_taken(page):
    kinds = list(markup.tokens(page))
    assert all(k in ("text", "hidden", "start", "end") for k, _, _ in kinds)
    assert markup.text_of(page.replace("<", "").replace("&", "")) == page.replace("<", "").replace("&", "").strip(markup.JAVA_SPACE)


def test_long_texts_take_linear_time():
    for page in ("<" * 300_000, "<a " * 200_000, "<!-- " * 200_000, '<a b="' * 200_000, "</title " * 200_000, "&" * 300_000, "<title>" * 50_000):
        markup.text_of(page)
