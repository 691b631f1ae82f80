"""A Spark data source of fetched pages, with the fetching itself pluggable.

``register(spark)`` makes ``spark.read.format("fetched_pages")`` available.  It reads saved responses
(a folder with ``index.jsonl``: url, status, file) and is the place where a networked fetcher would
be plugged in: one partition for each host, so that a host's pacing holds in one task, and the rules
for retries, redirects and robots files, which are plain functions here.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = "url string, final_url string, host string, status int, attempt int, waited double, body binary, error string"
#: Answers worth another attempt.
RETRIED = frozenset((408, 429, *range(500, 600)))
MOST_HOPS = 6

Fetch = Callable[[str], tuple[int, dict, bytes]]


def with_retries(fetch: Fetch, url: str, retries: int = 3, interval: float = 3.0, most_bytes: int = 80 * 1024 * 1024, wait: Callable[[float], None] = lambda _: None) -> tuple[int, dict, bytes, int, float]:
    """(status, headers, body, attempts, seconds waited): retries on busy answers and connection errors, doubling the pause, at least what Retry-After says."""
    waited = 0.0
    for attempt in range(1, retries + 2):
        try:
            status, headers, body = fetch(url)
            if len(body) > most_bytes:
                raise ValueError("the answer is too large")
            if status not in RETRIED or attempt > retries:
                return status, headers, body, attempt, waited
            told = headers.get("retry-after", "0")
            pause = max(2.0**attempt, float(told) if told.isdigit() else 0.0, interval)
        except OSError:
            if attempt > retries:
                raise
            pause = max(2.0**attempt, interval)
        wait(pause)
        waited += pause
    raise AssertionError("unreachable")


def followed(fetch: Fetch, url: str, allowed: Callable[[str], bool] = lambda _: True, **options) -> tuple[str, int, bytes, int, float]:
    """(final url, status, body, attempts, waited): follows redirects, asks for each hop, refuses loops and more than six hops; must end with 200."""
    seen, at = set(), url
    for _ in range(MOST_HOPS + 1):
        if at in seen:
            raise ValueError("redirect loop")
        if not allowed(at):
            raise PermissionError("refused by robots")
        seen.add(at)
        status, headers, body, attempts, waited = with_retries(fetch, at, **options)
        if status in (301, 302, 303, 307, 308) and headers.get("location"):
            at = urljoin(at, headers["location"])
        elif status == 200:
            return at, status, body, attempts, waited
        else:
            raise ValueError(f"status {status}")
    raise ValueError("too many redirects")


def robots_rules(status: int, body: bytes, agent: str = "*") -> tuple[Callable[[str], bool], float]:
    """What a robots file allows, and its crawl delay.  Missing (404, 410) allows all; any other failure, or a page instead of a file, allows nothing."""
    if status in (404, 410):
        return (lambda _: True), 0.0
    text = body.decode("utf-8", "replace")
    if status != 200 or text.lstrip().lower().startswith(("<!doctype", "<html")):
        return (lambda _: False), 0.0
    rules = RobotFileParser()
    rules.parse(text.splitlines())
    return (lambda url: rules.can_fetch(agent, url)), float(rules.crawl_delay(agent) or 0)


def saved_fetch(folder: str, index: dict[str, dict]) -> Fetch:
    """Answers from a folder of saved responses; an unknown URL is a connection error."""
    def fetch(url: str) -> tuple[int, dict, bytes]:
        entry = index.get(url)
        if entry is None:
            raise OSError("no saved answer")
        body = b""
        if entry.get("file"):
            with open(os.path.join(folder, entry["file"]), "rb") as f:
                body = f.read()
        return int(entry.get("status", 200)), {k.lower(): v for k, v in entry.get("headers", {}).items()}, body

    return fetch


class Robots:
    """What the robots files of hosts allow, each read once and kept for ``keep`` seconds."""

    def __init__(self, fetch: Fetch, keep: float = 1800.0, clock: Callable[[], float] = time.monotonic):
        self.fetch, self.keep, self.clock = fetch, keep, clock
        self.known: dict[str, tuple[float, Callable[[str], bool], float]] = {}

    def rules(self, url: str) -> tuple[Callable[[str], bool], float]:
        parts = urlsplit(url)
        root = f"{parts.scheme}://{parts.netloc}"
        if root not in self.known or self.clock() - self.known[root][0] > self.keep:
            try:
                status, _, body = self.fetch(f"{root}/robots.txt")
            except OSError:
                status, body = 0, b""
            self.known[root] = (self.clock(), *robots_rules(status, body))
        return self.known[root][1:]

    def allowed(self, url: str) -> bool:
        return self.rules(url)[0](url)

    def delay(self, url: str) -> float:
        return self.rules(url)[1]


class Pacer:
    """Keeps a host's requests apart by an interval, or by its robots file's delay where that is longer.

    A host is read by one task (``HostPages``), so no lock between tasks is needed.
    """

    def __init__(self, fetch: Fetch, robots: Robots, interval: float, wait: Callable[[float], None], clock: Callable[[], float] = time.monotonic):
        self.inner, self.robots, self.interval, self.wait, self.clock = fetch, robots, interval, wait, clock
        self.last: dict[str, float] = {}
        self.waited = 0.0

    def __call__(self, url: str) -> tuple[int, dict, bytes]:
        host = urlsplit(url).hostname or ""
        pause = self.last.get(host, float("-inf")) + max(self.interval, self.robots.delay(url)) - self.clock()
        if pause > 0:
            self.wait(pause)
            self.waited += pause
        self.last[host] = self.clock()
        return self.inner(url)


class HostPages(InputPartition):
    """The pages of one host."""

    def __init__(self, host: str, urls: list[str]):
        self.host, self.urls = host, urls


class PageReader(DataSourceReader):
    """Reads the pages of an index; robots files are asked for on every hop, hosts are paced.

    A saved answer costs no network, so nothing waits unless the option ``interval`` says so; a host
    without a saved robots file counts as one that has none.
    """

    def __init__(self, folder: str, retries: int, interval: float = 0.0):
        self.folder, self.retries, self.interval = folder, retries, interval
        with open(os.path.join(folder, "index.jsonl"), encoding="utf-8") as lines:
            self.index = {e["url"]: e for e in map(json.loads, filter(str.strip, lines))}

    def partitions(self) -> list[HostPages]:
        by_host: dict[str, list[str]] = {}
        for url, entry in self.index.items():
            if entry.get("page", True) and not urlsplit(url).path.endswith("/robots.txt"):
                by_host.setdefault((urlsplit(url).hostname or "").lower(), []).append(url)
        return [HostPages(host, urls) for host, urls in by_host.items()]

    def read(self, partition: HostPages) -> Iterator[tuple]:
        saved = saved_fetch(self.folder, self.index)
        robots = Robots(lambda url: saved(url) if url in self.index else (404, {}, b""))
        fetch = Pacer(saved, robots, self.interval, time.sleep)
        wait = time.sleep if self.interval else lambda _: None
        for url in partition.urls:
            before = fetch.waited
            try:
                final, status, body, attempts, waited = followed(fetch, url, robots.allowed, retries=self.retries, wait=wait)
                yield url, final, partition.host, status, attempts, waited + fetch.waited - before, body, None
            except Exception as problem:  # noqa: BLE001
                yield url, None, partition.host, None, None, None, None, str(problem)[:300]


class FetchedPages(DataSource):
    """``spark.read.format("fetched_pages").option("retries", 3).load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"], int(self.options.get("retries", 3)), float(self.options.get("interval", 0)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FetchedPages)
