"""Steps of an update that run on the driver, a page, a file or a run at a time: discovery, series, and publishing."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import takewhile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import quality, series
from loomwright.sources import store

Page = tuple[list[dict], str | None]


class Checkpoint:
    """What a discovery has read so far, published page by page as one JSON text.

    pages: the addresses read; found: entries by URL; upcoming: the next page; ended: why it ended, ''
    while it has not.  It is valid for one configuration; another digest starts anew.
    """

    def __init__(self, spark: SparkSession, path: str, digest: str):
        self.spark, self.path = spark, path
        row = store.read_snapshot(spark, path, "digest string, state string").where(F.col("digest") == digest).first()
        self.digest = digest
        self.pages, self.found, self.upcoming, self.ended = json.loads(row["state"]) if row else ([], {}, None, "")

    def publish(self) -> None:
        text = json.dumps([self.pages, self.found, self.upcoming, self.ended], ensure_ascii=False)
        store.write_snapshot(self.spark.createDataFrame([(self.digest, text)], "digest string, state string"), self.path)


def trailing(flags: list[bool], before: int) -> int:
    """Length of the run of true flags at the end, going on from a run of ``before`` if all are true."""
    end = len(list(takewhile(bool, reversed(flags))))
    return before + end if end == len(flags) else end


def discover(point: Checkpoint, read: Callable[[str], Page], start: str, since: str, known: Callable[[str], bool] = lambda _: False, streak: int = 0) -> list[dict]:
    """Entries of a column's list pages, newest pages first, resumed where a run before stopped.

    ``read`` gives a page's entries and the next page.  What a page told is published before the next
    one is read, so a crash repeats at most one page.  A page without entries and a page met twice are
    errors.  It ends after a page that has nothing as recent as ``since``, after the page whose last
    ``streak`` recent entries are known (0: never; a run may begin on the page before), or with the last
    page; undated entries count as recent.  Each page names the next, so this is a loop over one
    column's list pages.
    """
    run = 0
    while not point.ended:
        page = point.upcoming or start
        if page in point.pages:
            raise ValueError(f"pages lead in a circle: {page}")
        entries, point.upcoming = read(page)
        if not entries:
            raise ValueError("a list page without entries cannot end a discovery")
        recent = [e for e in entries if (e["list_date"] or since) >= since]
        run = trailing([known(e["url"]) for e in recent], run)
        point.pages.append(page)
        point.found |= {e["url"]: e for e in recent}
        ends = {"before_since": not recent, "known_streak": 0 < streak <= run, "end": not point.upcoming}
        point.ended = next((why for why, holds in ends.items() if holds), "")
        point.publish()
    return list(point.found.values())


def update_series(spark: SparkSession, path: str, fetch: Callable[[], DataFrame], as_of: str, attempts: int = 2, **rules) -> DataFrame:
    """Replaces a stored price series (date, close) by a fetched one, if that is valid and ends no earlier.

    fetch: rows with at least ``date`` and ``close``.  After ``attempts`` failures the last error is
    raised and the stored series stays as it was.
    """
    stored = store.read_snapshot(spark, path, "date date, close double")
    last = stored.agg(F.date_format(F.max("date"), "yyyy-MM-dd")).first()[0]
    problem: Exception | None = None
    for _ in range(attempts):
        try:
            rows = quality.required(fetch(), ["date", "close"]).select(F.col("date").cast("date").alias("date"), F.col("close").cast("double").alias("close"))
            checked = series.not_older(series.validation(rows, "date", "close", as_of, **rules), last).first()
            if not checked["valid"]:
                raise ValueError(f"the series is not valid: {checked.asDict()}")
            store.write_snapshot(series.window_of(rows, "date", as_of).groupBy("date").agg(F.max("close").alias("close")), path)
            return store.read_snapshot(spark, path, "date date, close double")
        except Exception as failure:  # noqa: BLE001
            problem = failure
    raise RuntimeError("the update failed; the stored series is kept") from problem


def gated(collect: Callable[[], str], restore: Callable[[], None], analyse: Callable[[], int], publish: Callable[[], None], keep: Callable[[], None]) -> None:
    """One update of a candidate: collected whole, its cached readings put back, analysed without failures, then published.

    collect: the run's result; analyse: how many readings failed (deferred ones are no failures).
    Anything else than success leaves what is published as it is; ``keep`` saves reservations and
    paid readings in every case.
    """
    try:
        result = collect()
        if result != "success":
            raise RuntimeError(f"collection ended with {result!r}; the published site is kept")
        restore()
        failed = analyse()
        if failed:
            raise RuntimeError(f"{failed} readings failed; the published site is kept")
        publish()
    finally:
        keep()


def sample_report(readings: DataFrame, current: DataFrame, keys: list[str], head: list[str]) -> str:
    """A text with some chosen readings (analysis rows) in the order of ``keys``, each made from its record's current input.

    current: (id, input_hash).  A chosen record without a current reading is an error.  Only the rows
    of ``keys``, a short list of the caller's, come to the driver.
    """
    rows = readings.where(F.col("id").isin(*keys)).join(current, ["id", "input_hash"], "left_semi")
    text = F.to_json(F.coalesce("interpretation", F.lit(None)), {"ignoreNullFields": "false"})
    best = rows.groupBy("id").agg(F.max_by(F.struct("title", "url", "relevance", "review_status", text.alias("text"), "review_reasons"), "analysis_no").alias("r"))
    found = {row["id"]: row["r"] for row in best.collect()}
    missing = [k for k in keys if k not in found]
    if missing:
        raise ValueError(f"no reading of the current input: {missing}")
    lines = list(head)
    for r in (found[k] for k in keys):
        lines += [f"## {r['title']}", "", f"[原文]({r['url']})", "", f"相关性：{r['relevance']}；状态：{r['review_status']}", "", r["text"] or "", ""]
        if r["review_reasons"]:
            lines += ["核查提示：" + "；".join(r["review_reasons"]), ""]
    return "\n".join(lines)
