"""A paged HTTP list as a Spark data source (SRC-01, SRC-08, SRC-09, SRC-19, SRC-20), and the rate limits as pure state machines."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BUCKET, COOL_DOWN, TRIES, PAGES = 10, 17.0, 6, 200
BATCH, WINDOW, LEAST_BATCH = 9, 31.0, 3


@dataclass
class Bucket:
    """SRC-09: a bucket of requests, then a pause."""

    size: int = BUCKET
    pause: float = COOL_DOWN
    used: int = 0

    def wait(self) -> float:
        full = self.used >= self.size
        self.used = 1 if full else self.used + 1
        return self.pause if full else 0.0

    def refused(self) -> None:
        self.used = 0


@dataclass
class Batches:
    """SRC-20: batches that shrink by one, down to ``LEAST_BATCH``, whenever a request is refused."""

    size: int = BATCH
    pause: float = WINDOW
    used: int = 0

    def wait(self) -> float:
        full = self.used >= self.size
        self.used = 1 if full else self.used + 1
        return self.pause if full else 0.0

    def refused(self) -> None:
        self.size, self.used = max(LEAST_BATCH, self.size - 1), 0


Post = Callable[[str, dict], tuple[int, dict[str, str], Any]]


def post_with_retry(post: Post, url: str, payload: dict, rate: Bucket | Batches, sleep: Callable[[float], None] = time.sleep, tries: int = TRIES) -> Any:
    """SRC-09: waits for the limiter, honours Retry-After (and half a second more) on 429, two seconds on other errors."""
    for _ in range(tries):
        if (pause := rate.wait()) > 0:
            sleep(pause)
        status, headers, body = post(url, payload)
        if status == 200:
            return body
        if status == 429:
            rate.refused()
            after = {k.lower(): v for k, v in headers.items()}.get("retry-after")
            sleep(float(after) + 0.5 if after else COOL_DOWN)
        else:
            sleep(2.0)
    raise RuntimeError(f"{url}: no success in {tries} tries")


def http_post(url: str, payload: dict) -> tuple[int, dict[str, str], Any]:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=60) as r:
            return r.status, dict(r.headers), json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), None


def envelope(data: dict, page: int | None = None, size: int | None = None) -> dict:
    """SRC-08: the request body of a call, with paging if there is any."""
    return {"data": data, **({} if page is None else {"paging": {"pageNumber": page, "pageSize": size}})}


@dataclass
class Share(InputPartition):
    first: int
    step: int


class PagedReader(DataSourceReader):
    """Pages are dealt round-robin to partitions, each with its own limiter; a short page ends a share."""

    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.size = options["url"], int(options.get("pagesize", "20"))
        self.workers, self.pages, self.list = int(options.get("workers", "1")), int(options.get("pages", str(PAGES))), options.get("list", "items")

    def partitions(self) -> list[InputPartition]:
        return [Share(i + 1, self.workers) for i in range(self.workers)]

    def read(self, partition: Share) -> Iterator[tuple[int, int, str]]:
        rate = Bucket()
        for page in range(partition.first, self.pages + 1, partition.step):
            body = post_with_retry(http_post, self.url, envelope({}, page, self.size), rate)
            rows = body.get(self.list) or []
            for i, row in enumerate(rows):
                yield page, i, json.dumps(row, ensure_ascii=False)
            if len(rows) < self.size:
                return


class PagedList(DataSource):
    """``spark.dataSource.register(PagedList)``, then ``spark.read.format("paged").option("url", ...).load()``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page INT, pos INT, value STRING"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
