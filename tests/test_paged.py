import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from jobweave.session import setting
from jobweave.sources import paged
from jobweave.sources import postings as src

SIZES = {"a": 45, "b": 20, "c": 0, "d": 7, "slow": 30}


@pytest.fixture
def server():
    """Serves listings; some pages fail once, some always."""
    asked, sizes, lock = [], dict(SIZES), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url, query = urlparse(self.path), parse_qs(urlparse(self.path).query)
            company, offset, limit = url.path.strip("/"), int(query["offset"][0]), int(query["limit"][0])
            with lock:
                asked.append((company, offset, self.headers["User-Agent"]))
                again = sum(a[:2] == (company, offset) for a in asked) > 1
            if company == "gone" or (company, offset) == ("a", 20) and not again or (company, offset) == ("slow", 20):
                self.send_error(503, "quota", "see https://x/y?key=secret2 for more")
                return
            n = sizes.get(company, 0)
            entries = [{"title": f"{company}{k}", "externalPath": f"/{company}/{k}"} for k in range(offset, min(n, offset + limit))]
            body = json.dumps({"total": n, "jobPostings": entries}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    http.asked, http.sizes = asked, sizes
    http.options = {"url": f"http://127.0.0.1:{http.server_port}/{{company}}?key=secret1&offset={{offset}}&limit={{limit}}", "mindelay": 0, "maxdelay": 0, "useragent": "test"}
    yield http
    http.shutdown()


def paths(pages):
    return sorted(r.external_path for r in src.workday_listing(pages.select("company", "payload")).collect())


def every(**sizes):
    return sorted(f"/{c}/{k}" for c, n in sizes.items() for k in range(n))


def test_every_page_once(spark, server):
    pages = paged.listing(spark, ["a", "b", "c", "d"], pagespertask=1, **server.options)
    assert paths(pages) == every(a=45, b=20, d=7)
    assert sorted((r.company, r.page_offset) for r in pages.collect()) == [("a", 0), ("a", 20), ("a", 40), ("b", 0), ("c", 0), ("d", 0)]
    assert sorted(a[:2] for a in server.asked) == [("a", 0), ("a", 20), ("a", 20), ("a", 40), ("b", 0), ("c", 0), ("d", 0)]  # one page failed once
    assert {a[2] for a in server.asked} == {"test"}


def test_a_page_that_fails_is_told(spark, server):
    pages = paged.listing(spark, ["slow", "gone"], retries=1, **server.options)
    bad = {(r.company, r.page_offset): r.error for r in pages.where("payload IS NULL").collect()}
    assert set(bad) == {("slow", 20), ("gone", 0)} and all("503" in e and "secret" not in e and "?[redacted]" in e for e in bad.values())
    assert paths(pages) == every(slow=20)
    assert sum(a[0] == "gone" for a in server.asked) == 2


def test_one_task_a_company(spark, server):
    spark.dataSource.register(paged.PagedListing)
    options = {k: str(v) for k, v in server.options.items()} | {"companies": json.dumps(list(SIZES)), "retries": "0"}
    pages = spark.read.format("paged_listing").options(**options).load()
    got = {(r.company, r.page_offset): r.payload is not None for r in pages.collect()}
    assert {k for k, ok in got.items() if not ok} <= {("a", 20), ("slow", 20)} and {("a", 40), ("b", 0), ("c", 0), ("d", 0), ("slow", 0), ("slow", 20)} <= set(got)


def test_filters_reach_the_source(spark, server):
    spark.dataSource.register(paged.PagedListing)
    options = {k: str(v) for k, v in server.options.items()} | {"companies": json.dumps(list(SIZES)), "pushdown": "true"}
    with setting(spark, "spark.sql.python.filterPushdown.enabled", "true"):
        pages = spark.read.format("paged_listing").options(**options).load()
        assert paths(pages.where("company = 'b'")) == every(b=20)
        assert paths(pages.where(F.col("company").isin("d", "c"))) == every(d=7)
    assert {a[0] for a in server.asked} == {"b", "c", "d"}


def test_stream_of_new_entries(spark, server, tmp_path):
    spark.dataSource.register(paged.PagedListing)
    options = {k: str(v) for k, v in server.options.items()} | {"companies": json.dumps(["b", "d"])}

    def go():
        stream = spark.readStream.format("paged_listing").options(**options).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start().awaitTermination()
        return sorted((r.company, r.page_offset) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert go() == [("b", 0), ("d", 0)]
    server.sizes["b"] = 50
    assert go() == [("b", 0), ("b", 20), ("b", 40), ("d", 0)]


def test_redacted():
    assert paged.redacted("a https://x/y?key=1&b=2 c? 'z?q'") == "a https://x/y?[redacted] c?[redacted] 'z?[redacted]'"
