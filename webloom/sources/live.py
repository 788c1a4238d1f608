"""Live readers as Python data sources; everything they return has the schema of a snapshot relation.

``spark.dataSource.register(HttpSnapshot)`` then ``spark.read.format("http_snapshot").option("urls", json).load()``.
Requests run on the executors, one connection pool a partition. There is no retry beyond what a
backend's rule says, and nothing is cached here.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from time import sleep

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from webloom.session import ship_package

TIMEOUT, PROBE_TIMEOUT, BODY_CAP = 30, 5, 20 << 20
AGENT = "webloom/0.1"
SNAPSHOT = "url string, status int, content_type string, etag string, last_modified string, body string"
_ARROW = pa.schema([(f.split()[0], pa.int32() if f.endswith(" int") else pa.string()) for f in SNAPSHOT.split(", ")])


def get(url: str, headers: dict[str, str] | None = None, timeout: float = TIMEOUT) -> tuple:
    """(url, status, content type, etag, last modified, body); a request that fails has status 0 and its reason as body."""
    req = urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept": "text/html,application/xhtml+xml,*/*;q=0.8"} | (headers or {}))
    try:
        with urllib.request.urlopen(req, timeout=timeout) as r:
            body = r.read(BODY_CAP).decode(r.headers.get_content_charset() or "utf-8", "replace")
            return url, r.status, r.headers.get("Content-Type"), r.headers.get("ETag"), r.headers.get("Last-Modified"), body
    except urllib.error.HTTPError as e:
        return url, e.code, e.headers.get("Content-Type"), e.headers.get("ETag"), e.headers.get("Last-Modified"), None
    except (OSError, ValueError) as e:
        return url, 0, None, None, None, str(e)


def fetch_all(urls: DataFrame, concurrency: int = 8, headers: dict[str, str] | None = None) -> DataFrame:
    """Snapshot rows of ``urls(url)``, fetched on the executors by ``concurrency`` tasks; nothing passes the driver."""
    if concurrency < 1:
        raise ValueError("concurrency must be at least 1")
    ship_package(urls.sparkSession)
    names = [f.split()[0] for f in SNAPSHOT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([dict(zip(names, get(u, headers), strict=True))], schema=_ARROW)

    return urls.select("url").repartition(concurrency).mapInArrow(run, SNAPSHOT)


class _Part(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class _SnapshotReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options.get("urls", "[]"))
        self.headers = json.loads(options.get("headers", "{}"))
        self.concurrency = int(options.get("concurrency", 8))
        if self.concurrency < 1:
            raise ValueError("concurrency must be at least 1")

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.concurrency, len(self.urls)))
        return [_Part(self.urls[i::n]) for i in range(n)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for u in partition.urls:
            yield get(u, self.headers)


class HttpSnapshot(DataSource):
    """The web as a table: one row a url asked for."""

    @classmethod
    def name(cls) -> str:
        return "http_snapshot"

    def schema(self) -> str:
        return SNAPSHOT

    def reader(self, schema) -> DataSourceReader:
        return _SnapshotReader(self.options)


def search_request(backend: str, query: str, limit: int, options: dict) -> tuple[str, dict[str, str]]:
    """(url, headers) of a backend's search; limits go to those backends that take them.

    Fixed values: the services' addresses, parameters and headers.
    """
    q = urllib.parse.quote_plus(query, safe="~")
    if backend == "brave":
        return f"https://api.search.brave.com/res/v1/web/search?q={q}&count={limit}", {"Accept": "application/json", "X-Subscription-Token": options.get("brave_api_key", "")}
    if backend == "searxng":
        return f"{options.get('searxng_url', 'http://localhost:8081').rstrip('/')}/search?q={q}&format=json&pageno=1", {}
    if backend == "ddg":
        return f"https://html.duckduckgo.com/html/?q={q}", {}
    if backend == "sourcegraph":
        return f"{options.get('sourcegraph_url', 'https://sourcegraph.com').rstrip('/')}/.api/search/stream?q={q}&display={limit}", {"Accept": "text/event-stream"}
    if backend == "github":
        per_page = limit if 0 < limit <= 100 else 30
        return f"https://api.github.com/search/code?q={q}&per_page={per_page}", {"Accept": "application/vnd.github.text-match+json", "Authorization": f"Bearer {options.get('github_token', '')}"}
    if backend == "context7":
        return f"https://context7.com/api/v2/libs/search?query={q}", {"Authorization": f"Bearer {options.get('context7_api_key', '')}"}
    if backend == "context7-docs":
        library, text, tokens = json.loads(query)
        about = urllib.parse.urlencode({"libraryId": library, "query": text, "type": "json", "tokens": tokens})
        return f"https://context7.com/api/v2/context?{about}", {"Authorization": f"Bearer {options.get('context7_api_key', '')}"}
    raise ValueError(f"unknown backend {backend!r}")


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.queries = json.loads(options.get("queries", "[]"))

    def partitions(self) -> list[InputPartition]:
        return [_Part([(i, q)]) for i, q in enumerate(self.queries)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        backend, limit = self.options.get("backend", "brave"), int(self.options.get("limit", 5))
        for request, q in partition.urls:
            url, headers = search_request(backend, q, limit, self.options)
            for attempt in range(1, 4):
                _, status, _, _, _, body = get(url, headers)
                yield request, attempt, status, body
                if backend != "ddg" or status != 202:
                    break
                sleep(0.5)


class SearchPayload(DataSource):
    """Raw answers of a search backend: ``request_id, attempt, status, body``."""

    @classmethod
    def name(cls) -> str:
        return "search_payload"

    def schema(self) -> str:
        return "request_id int, attempt int, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(HttpSnapshot)
    spark.dataSource.register(SearchPayload)
