"""Cursor pages of a REST service as a Spark data source: one partition a target, page by page, with retries.

    spark.dataSource.register(CursorPages)
    spark.read.format("cursor_pages").option("url", "http://host/works").option("targets", '["a", "b"]').load()

A page is JSON: ``results`` (an array) and ``meta.next_cursor``; it is asked for with ``target``, ``cursor`` (first ``*``) and ``per-page``. Paging ends
without a further cursor or results, or after ``max_pages``. Answers 429 and 5xx, and broken connections, are tried again after a
growing pause, ``tries`` times in all. With ``enabled`` false nothing is asked, and with ``cache`` (JSON: target to list of pages) its pages are
read first. Each row is a result, or, where a target gave none, its status alone:

    target, page, item_index, item (JSON text), status (fetched, cache_hit, skipped_api_disabled, skipped_no_query, http_N, json_error,
    request_error:<name>), cursor (that the page was asked with)

As a stream (one target) the cursor is the offset: a batch holds the pages from one cursor to the next, and a restarted query goes on at the
cursor of its checkpoint.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "target string, page int, item_index int, item string, status string, cursor string"
START = "*"


def ask(url: str, params: dict[str, str], tries: int, pause: float) -> tuple[str, dict | None]:
    """The status of a request, and its page."""
    status = "request_error:none"
    for attempt in range(max(1, tries)):
        if attempt:
            time.sleep(pause * 2 ** (attempt - 1))
        try:
            with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=20) as answer:
                body = answer.read()
            try:
                page = json.loads(body)
            except ValueError:
                return "json_error", None
            return ("fetched", page) if isinstance(page, dict) else ("json_error", None)
        except urllib.error.HTTPError as e:
            status = f"http_{e.code}"
            if e.code != 429 and e.code < 500:
                break
        except OSError as e:
            status = f"request_error:{type(e).__name__}"
    return status, None


def _rows(target: str, number: int, status: str, page: dict, cursor: str) -> Iterator[tuple]:
    for i, item in enumerate(page.get("results") or []):
        yield target, number, i, json.dumps(item, sort_keys=True, ensure_ascii=False), status, cursor


def _next(page: dict) -> str | None:
    return (page.get("meta") or {}).get("next_cursor") if page.get("results") else None


class _Options:
    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.targets: list[str] = json.loads(options.get("targets", "[]"))
        self.enabled = options.get("enabled", "true").lower() == "true"
        self.most = int(options.get("max_pages", "0"))
        self.size = options.get("page_size", "200")
        self.tries, self.pause = int(options.get("tries", "3")), float(options.get("pause", "0.5"))
        self.cache: dict[str, list[dict]] = json.loads(options.get("cache", "{}"))

    def page(self, target: str, cursor: str) -> tuple[str, dict | None]:
        return ask(self.url, {"target": target, "cursor": cursor, "per-page": self.size}, self.tries, self.pause)


class Target(InputPartition):
    def __init__(self, target: str):
        super().__init__(target)


class PageReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Target]:
        return [Target(t) for t in self.options.targets]

    def read(self, partition: Target) -> Iterator[tuple]:
        o, target = self.options, partition.value
        if not (target or "").strip():
            yield target, None, None, None, "skipped_no_query", None
        elif target in o.cache:
            found = False
            for number, page in enumerate(o.cache[target], 1):
                for row in _rows(target, number, "cache_hit", page, START if number == 1 else ""):
                    found = True
                    yield row
            if not found:
                yield target, None, None, None, "cache_hit", None
        elif not o.enabled:
            yield target, None, None, None, "skipped_api_disabled", None
        else:
            cursor, number = START, 0
            while cursor and not (o.most and number >= o.most):
                number += 1
                status, page = o.page(target, cursor)
                if page is None:
                    yield target, number, None, None, status, cursor
                    return
                rows = list(_rows(target, number, status, page, cursor))
                yield from rows
                if not rows and number == 1:
                    yield target, number, None, None, status, cursor
                cursor = _next(page)


class PageStream(SimpleDataSourceStreamReader):
    """Pages of one target; the offset is the cursor to ask with next, and how many pages came before it."""

    def __init__(self, options: _Options):
        if len(options.targets) != 1:
            raise ValueError("a stream of pages has one target")
        self.options, self.target = options, options.targets[0]

    def initialOffset(self) -> dict:
        return {"cursor": START, "page": 0}

    def _page(self, start: dict) -> tuple[list[tuple], dict]:
        if not start["cursor"]:
            return [], start
        status, page = self.options.page(self.target, start["cursor"])
        if page is None:
            raise RuntimeError(f"{self.target}: {status}")  # the batch fails and is tried again from its offset
        number = start["page"] + 1
        return list(_rows(self.target, number, status, page, start["cursor"])), {"cursor": _next(page) or "", "page": number}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._page(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start["page"] < end["page"]:
            rows, start = self._page(start)
            yield from rows

    def commit(self, end: dict) -> None:
        pass


class CursorPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(_Options(self.options))

    def simpleStreamReader(self, schema: StructType) -> PageStream:
        return PageStream(_Options(self.options))
