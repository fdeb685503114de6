"""Listings that a server gives page by page, as a data source of Spark: `spark.read.format("paged_listing")`.

A row is a page: company, page_offset, payload and error. What a page is fetched with is injected (option `fetcher`); a page
that fails for good has an error, without the URL's query, in the place of its payload, and is for the next pass to ask again: nothing is lost
in silence, and no page fails the job. Requests within a task follow each other with a pause; how many tasks ask at a time is the
number of cores that the job gets.
"""

from __future__ import annotations

import importlib
import json
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from ..session import scratch

SCHEMA = "company string, page_offset int, payload string, error string"


class HttpFetcher:
    """Plain HTTP. Options: useragent, timeout (seconds for a request)."""

    def __init__(self, options: dict[str, str]):
        self.agent, self.timeout = options.get("useragent", "jobweave"), float(options.get("timeout", "30"))

    def get(self, url: str) -> str:
        request = urllib.request.Request(url, headers={"User-Agent": self.agent})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as response:
                return response.read().decode(response.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:  # the reason is often in the body
            raise OSError(f"status {e.code}: {e.read().decode('utf-8', 'replace')[:500]}") from None


class FolderFetcher:
    """Pages that something else landed, as text files in a folder a page; the URL is the folder's."""

    def __init__(self, options: dict[str, str]):
        pass

    def get(self, url: str) -> str:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(url)
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name.startswith("part-"))
        return "".join(system.open_input_stream(f).read().decode() for f in files)


def redacted(text: str) -> str:
    """Queries of URLs may hold keys."""
    return re.sub(r"(?<=\S)\?[^\s'\"<>]*", "?[redacted]", text)


@dataclass
class _Pages(InputPartition):
    company: str
    offsets: tuple[int, ...]


class _Asking:
    """Options: url (with {company}, {offset} and {limit}), companies (JSON array), pagesize, total (the JSON field with a listing's
    length), retries, mindelay and maxdelay (seconds between requests), fetcher (module:class, made with the options), pagespertask;
    pages: all, or first; totals (JSON object: lengths that are known, whose first pages are left out)."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.size = int(options.get("pagesize", "20"))
        self.companies: list[str] = json.loads(options["companies"])

    def _fetcher(self) -> Any:
        module, _, name = self.options.get("fetcher", "jobweave.sources.paged:HttpFetcher").partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def _pause(self, factor: int = 1) -> None:
        low, high = float(self.options.get("mindelay", "2")), float(self.options.get("maxdelay", "5"))
        time.sleep(factor * random.uniform(low, max(low, high)))

    def _page(self, fetcher: Any, company: str, offset: int) -> tuple[str, int, str | None, str | None]:
        """A page, asked again up to `retries` times, after longer and longer pauses."""
        url = self.options["url"].format(company=company, offset=offset, limit=self.size)
        error = None
        for attempt in range(int(self.options.get("retries", "2")) + 1):
            if attempt:
                self._pause(2 ** (attempt - 1))
            try:
                return company, offset, fetcher.get(url), None
            except Exception as e:  # noqa: BLE001 - whatever a fetcher raises
                error = redacted(f"Request to {url} failed: {type(e).__name__}: {e}")
        return company, offset, None, error

    def total(self, payload: str | None) -> int:
        try:
            return int(json.loads(payload or "{}")[self.options.get("total", "total")])
        except (ValueError, KeyError, TypeError):
            return 0

    def ranges(self, company: str, start: int, end: int) -> list[_Pages]:
        offsets, n = range(start - start % self.size, end, self.size), int(self.options.get("pagespertask", "50"))
        return [_Pages(company, tuple(offsets[k : k + n])) for k in range(0, len(offsets), n)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        fetcher, known = self._fetcher(), partition.offsets
        for k, offset in enumerate(known):
            if k:
                self._pause()
            yield self._page(fetcher, partition.company, offset)


class _Batch(_Asking, DataSourceReader):
    def partitions(self) -> list[_Pages]:
        if "totals" in self.options:
            totals = json.loads(self.options["totals"])
            return [p for c in self.companies for p in self.ranges(c, self.size, totals.get(c, 0))]
        return [_Pages(c, (0,)) for c in self.companies]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        if "totals" in self.options or self.options.get("pages", "all") == "first":
            yield from super().read(partition)
            return
        # A company's listing from begin to end; its length comes with each page.
        fetcher, offset, end = self._fetcher(), 0, 1
        while offset < end:
            if offset:
                self._pause()
            page = self._page(fetcher, partition.company, offset)
            end = max(end, self.total(page[2])) if page[2] is None or not offset else self.total(page[2])
            yield page
            offset += self.size


class _Pushing(_Batch):
    """Asks those companies only that a filter names."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("company",):
                self.companies = [c for c in self.companies if c == f.value]
            elif isinstance(f, In) and f.attribute == ("company",):
                self.companies = [c for c in self.companies if c in f.value]
            yield f  # and Spark looks once more


class _Stream(_Asking, DataSourceStreamReader):
    """Offsets are the listings' lengths: a batch holds the pages in which entries lie that came since the one before."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fetcher, out = self._fetcher(), {}
        for k, company in enumerate(self.companies):
            if k:
                self._pause()
            out[company] = self.total(self._page(fetcher, company, 0)[2])
        self.known = {c: max(n, getattr(self, "known", {}).get(c, 0)) for c, n in out.items()}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[_Pages]:
        return [p for c, n in end.items() if n > start.get(c, 0) for p in self.ranges(c, start.get(c, 0), n)]


class PagedListing(DataSource):
    """See the module and _Asking for the options. pushdown=true hands filters on company to the source (Spark must allow it by
    spark.sql.python.filterPushdown.enabled)."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_Pushing if self.options.get("pushdown", "false").lower() == "true" else _Batch)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def listing(spark: SparkSession, companies: list[str], **options: str | int | float) -> DataFrame:
    """Every page of the companies' listings, landed: first pages by one task a company, then all other pages, of whose number the
    first ones tell, dealt over tasks, so that a long listing isn't one task. Each page is asked for once, but for retries."""
    spark.dataSource.register(PagedListing)
    given = {k: str(v) for k, v in options.items()} | {"companies": json.dumps(companies)}
    path = scratch(spark, "pages")
    reading = spark.read.format("paged_listing").options(**given)
    reading.option("pages", "first").load().write.parquet(f"{path}/part=first")
    first = spark.read.schema(SCHEMA).parquet(f"{path}/part=first")
    total = F.get_json_object("payload", f"$.{options.get('total', 'total')}").try_cast("int")
    totals = {r.company: r.n for r in first.select("company", F.coalesce(total, F.lit(0)).alias("n")).collect()}  # a row a company
    reading.option("totals", json.dumps(totals)).load().write.parquet(f"{path}/part=rest")
    return spark.read.schema(SCHEMA).parquet(f"{path}/part=first", f"{path}/part=rest")
