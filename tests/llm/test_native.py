import hashlib
import re

import pytest
from pyspark.sql import functions as F

from jobweave.llm import decontaminate, exact_dedup, licenses, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, h string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "clash", "clash") for i, t in rows], DOCS)


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, g in groups.items():
        best = sorted(g, key=lambda r: (-len(r[1]), r[0] is None, r[0]))[0][0]
        out += [(i, best, len(g), i == best, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in g]
    return sorted(out, key=str)


LONG = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(40_000))
EXACT = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " "), (7, LONG), (8, LONG + " "), (9, LONG[1:]), (10, LONG[:-1]), (None, "ab"), (2, "ab"), (11, "é\u00a0b"), (12, "éb"), (13, "😀" * 3000), (14, "😀 " * 3000), (15, LONG * 30), (16, LONG * 30 + "!"), (17, " ".join(LONG * 30))]


@pytest.mark.parametrize(("bits", "few"), [(None, 1_000_000), (2, 1_000_000), (2, 1), (9, 1_000_000)])
def test_exact_dedup(spark, monkeypatch, bits, few):
    """With a hash of two bits nearly all chunks collide, with nine some: the ordinals have to tell them apart."""
    monkeypatch.setattr(exact_dedup, "FEW", few)
    kind = (lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))) if bits else exact_dedup.chunk_hash
    out = exact_dedup.exact_duplicates(docs(spark, EXACT), kind)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_exact(EXACT)
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_url_filter(spark, monkeypatch):
    urls = [None, "", "nohost", "http://A.ORG/x", "https://example.org/es/1", "http://x.example.org/en/12?q", "http://badexample.org/es/", "http://a.com/fr/x", "http://a.com/fr", "http://com/de/1", "http://spam.net/p/1/", "https://www.spam.net/p/1?x#y", "http://spam.net/p/2", "http://a.org", "ftp://a.com?x://b.org/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("spam.net/p/1",), (None,), ("spam.net/p/1",), *((f"other.net/{i}",) for i in range(100))], "url string")
    rows = url_filter.filter_urls(pages, listed).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in rows] == [(None, "allow")] * 3 + [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), (None, "allow"), ("com/de/", "block"), (None, "block"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert (rows[3].host, rows[3].path, rows[14].host, rows[14].path) == ("a.org", "/x", "a.com", "")
    for name in ("MAX_BROADCAST_BLOCKS", "MAX_BROADCAST_KEYS"):  # the ways beyond the bounds
        monkeypatch.setattr(url_filter, name, 1)
        assert url_filter.filter_urls(pages, listed).orderBy("page_id").collect() == rows
    assert url_filter.filter_urls(pages, listed.limit(0)).where("listed").count() == 0


def test_url_filter_false_positives_and_repeats(spark, monkeypatch):
    """A filter of one block passes nearly everything: the exact join has to tell."""
    monkeypatch.setattr(url_filter, "KEYS_PER_BLOCK", 10_000)
    pages = spark.createDataFrame([(i % 50, f"http://h.net/{i % 300}") for i in range(400)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h.net/{i}",) for i in range(0, 300, 3)], "url string")
    keys = listed.select(F.col("url").alias("key"))
    passed = pages.select(F.regexp_replace("url", "http://", "").alias("key")).crossJoin(url_filter.bloom(keys, 1)).where(url_filter.may_hold(F.col("key"), 1)).count()
    assert passed > 300
    out = url_filter.filter_urls(pages, listed)
    assert sorted((r.page_id, r.path, r.verdict) for r in out.collect()) == sorted((i % 50, f"/{i % 300}", "block" if i % 300 % 3 == 0 else "allow") for i in range(400))
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0


def test_block_list(spark):
    pages = spark.createDataFrame([(i, f"https://www.Site{i}.net/p/{i}/?q") for i in range(40)] + [(40, None)], "page_id long, url string")
    want = [f"site{i}.net/p/{i}" for i in range(40)]
    want = sorted(u + end for u in want if hashlib.md5(u.encode()).hexdigest()[0] in "0123" for end in ("", "/listed"))
    assert sorted(r.url for r in url_filter.block_list(pages).collect() if r.url and not r.url.startswith("/")) == want


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_contamination(rows, items):
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for item, text in items:
            v = words(text)
            n = min(13, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[k : k + n]:
                        hit.update(range(at, at + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination(spark):
    item = " ".join(f"w{i}" for i in range(30))
    items = [(1, item), (10, "Short one"), (2, "solo"), (3, None), (4, "!!"), (5, item), (6, "the the the the the the the the the the the the the the")]
    rows = [(1, "x " + item.upper() + " y"), (2, "short, ONE"), (3, None), (4, ""), (5, "..."), (6, " ".join(f"w{i}" for i in range(5, 18))), (7, " ".join(f"w{i}" for i in range(12))), (8, "the " * 40), (9, "solo " + "z " * 30), (9, "solo " + "z " * 30), (None, "é solo É"), (11, item + " " + "q " * 900)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")
    for inline in (decontaminate.MAX_INLINE, 1):
        out = decontaminate.contamination(docs(spark, rows), bench, max_inline=inline).drop("items", "spans")
        assert sorted((tuple(r) for r in out.collect()), key=str) == brute_contamination(rows, items)
    big = [(1, item), (2, "a b c " * 400_000 + item), (3, "a b c " * 400_000)]  # texts of over two MB
    out = decontaminate.contamination(docs(spark, big), bench).select("doc_id", "n_words", "n_hit", "n_items").collect()
    assert sorted(map(tuple, out)) == [(1, 30, 30, 2), (2, 1_200_030, 30, 2), (3, 1_200_000, 0, 0)]
    assert sorted(r.doc_id or 0 for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()) == [3, 4, 5, 7, 9, 9, 11]
    assert decontaminate.contamination(docs(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0


def test_licenses(spark, monkeypatch):
    mit = next(t for x, t in licenses.TEMPLATES if x == "MIT")
    rows = [(1, "Text that goes before.\nReleased under the MIT License.\nMore of it."), (2, "(c) 2020 Someone\n\n" + mit.replace(". ", ".\n")), (3, "Nothing here"), (4, None), (5, ""), (6, "licensed UNDER the Apache license version 2.0"), (6, "licensed UNDER the Apache license version 2.0"), (7, mit + "".join(f" word{i}" for i in range(3000))), (8, "license")]
    out = {r.doc_id: (r.licenses, r.n_units) for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert out[1] == (["MIT"], 1) and "MIT" in out[2][0] and out[6][0] == ["Apache-2.0"]
    assert all(out[i] == ([], 0) for i in (3, 4, 5, 7, 8))
    for name in ("MAX_BROADCAST", "MAX_MARKS"):  # the ways beyond the bounds
        monkeypatch.setattr(licenses, name, 0)
        assert {r.doc_id: (r.licenses, r.n_units) for r in licenses.scan_licenses(docs(spark, rows)).collect()} == out
    assert licenses.scan_licenses(docs(spark, [])).count() == 0
    long = [(1, "plain words " * 200_000 + "\nReleased under the MIT License.\n" + "x" * 1_000_000), (2, "y\n" * 300_000)]
    assert sorted((r.doc_id, r.licenses) for r in licenses.scan_licenses(docs(spark, long)).collect()) == [(1, ["MIT"]), (2, [])]
