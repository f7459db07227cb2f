"""JSON over HTTP: requests with retries, a cache of answers, search and extracts, and blocks of rows.

These run on the driver, as a source of tables: a service that limits requests does not get faster with executors. The
``opener`` takes a URL and gives (status, headers, body), so that they work with any client, and in tests without one.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from quarrymill.sources.jsonl import append_decisions, read_jsonl_or_empty

Opener = Callable[[str], tuple[int, dict[str, str], bytes]]
#: Attempts, longest pause in seconds, and answers after which a request is repeated. Fixed values.
ATTEMPTS, LONGEST = 7, 30.0
BUSY = frozenset({429})
UNWELL = frozenset({429, 500, 502, 503, 504})
#: Pages of one request for extracts.
TOGETHER = 20


class HttpError(RuntimeError):
    def __init__(self, status: int, url: str):
        super().__init__(f"{status} from {url}")
        self.status = status


def open_url(url: str, timeout: float = 60.0) -> tuple[int, dict[str, str], bytes]:
    """The standard library's client."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url), timeout=timeout) as answer:
            return answer.status, {k.lower(): v for k, v in answer.headers.items()}, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, b""


def get_json(url: str, opener: Opener = open_url, repeat: frozenset[int] = BUSY, pause: Callable[[float], None] = time.sleep) -> dict:
    """The answer as JSON. Answers in ``repeat`` are asked for again: after the pause that the service names, or after
    2, 4, 8 ... seconds up to ``LONGEST``; the last attempt's answer, like any other error, raises."""
    for attempt in range(1, ATTEMPTS + 1):
        status, headers, body = opener(url)
        if status < 400:
            return json.loads(body)
        if status not in repeat or attempt == ATTEMPTS:
            raise HttpError(status, url)
        named = headers.get("retry-after", "")
        pause(float(named) if named.replace(".", "", 1).isdigit() else min(2.0**attempt, LONGEST))
    raise AssertionError


class CachedSource:
    """Answers by the SHA-256 of their query, in a JSON-lines log in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, base: str, path: str, opener: Opener = open_url, pause: Callable[[float], None] = time.sleep):
        self.spark, self.base, self.path, self.opener, self.pause = spark, base, path, opener, pause
        rows = read_jsonl_or_empty(spark, path, "key string, answer string")
        self.fresh: dict[str, str] = {}
        self._there = rows

    @staticmethod
    def key(params: dict) -> str:
        return hashlib.sha256(urllib.parse.urlencode(params).encode()).hexdigest()

    def get(self, params: dict) -> dict:
        """The answer to a query, from the log if it has it."""
        key = self.key(params)
        if key not in self.fresh:
            known = self._there.where(f"key = '{key}'").first()
            self.fresh[key] = known["answer"] if known else json.dumps(get_json(f"{self.base}?{urllib.parse.urlencode(params)}", self.opener, pause=self.pause))
        return json.loads(self.fresh[key])

    def keep(self) -> None:
        """Append what is new to the log."""
        if self.fresh:
            append_decisions(self.spark.createDataFrame(list(self.fresh.items()), "key string, answer string"), self.path, "key")

    def search(self, words: str, limit: int) -> list[int]:
        """Page ids that a full-text search finds, best first."""
        found = self.get({"action": "query", "list": "search", "srsearch": words, "srlimit": limit, "format": "json", "formatversion": 2})
        return [hit["pageid"] for hit in found.get("query", {}).get("search", []) if hit.get("pageid")]

    def extracts(self, page_ids: Iterable[int]) -> Iterator[tuple[str, str, str, str]]:
        """page_id, url, title, extract, ``TOGETHER`` pages a request."""
        ids = list(page_ids)
        for i in range(0, len(ids), TOGETHER):
            some = "|".join(map(str, ids[i : i + TOGETHER]))
            found = self.get({"action": "query", "prop": "extracts|info", "inprop": "url", "explaintext": 1, "pageids": some, "format": "json", "formatversion": 2})
            for page in found.get("query", {}).get("pages", []):
                yield str(page["pageid"]), page.get("fullurl", ""), page.get("title", ""), page.get("extract", "")

    def pages(self, page_ids: Iterable[int]) -> DataFrame:
        """The same as a table, which then feeds the windows and matches like ``pages``."""
        return self.spark.createDataFrame(list(self.extracts(page_ids)), "page_id string, url string, title string, extract string")


def dataset_rows(base: str, params: dict, blocks: Iterable[tuple[int, int]], opener: Opener = open_url, pause: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Rows of a dataset service for blocks (offset, length); a service that is unwell is asked again."""
    for offset, length in blocks:
        answer = get_json(f"{base}?{urllib.parse.urlencode({**params, 'offset': offset, 'length': length})}", opener, UNWELL, pause)
        for item in answer.get("rows", []):
            yield item["row"]
