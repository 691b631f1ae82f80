"""Faceted search, paging, recency and related records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwright.functions.text import all_terms


@dataclass(frozen=True)
class Facets:
    """What a search asks for; empty values ask for nothing. ``arrays`` and ``scalars`` go by column name."""

    query: str = ""
    arrays: tuple[tuple[str, str], ...] = ()
    scalars: tuple[tuple[str, str], ...] = ()
    since: str = ""
    until: str = ""


def matching(items: DataFrame, facets: Facets, text: str = "text", date: str = "date") -> DataFrame:
    """Items that fulfil every facet: all terms, array facets by membership, scalars by equality, inclusive dates that need a date."""
    found = all_terms(F.col(text), facets.query)
    for column, value in facets.arrays:
        if value:
            found = found & F.array_contains(column, value)
    for column, value in facets.scalars:
        if value:
            found = found & (F.col(column) == value)
    if facets.since:
        found = found & (F.col(date) != "") & (F.col(date) >= facets.since)
    if facets.until:
        found = found & (F.col(date) != "") & (F.col(date) <= facets.until)
    return items.where(found)


def page(items: DataFrame, order: list[Column], number: int, size: int = 12) -> DataFrame:
    """The items of one page in order; a number beyond the ends is the nearest page. Only as many rows as the pages up to there are kept while sorting."""
    total = items.count()
    last = max(1, -(-total // size))
    number = min(max(1, number), last)
    return items.orderBy(*order).offset((number - 1) * size).limit(size)


def display_date(publish: Column, listed: Column) -> Column:
    """The publication date, else the list date, else ''."""
    return F.coalesce(F.nullif(publish, F.lit("")), F.nullif(listed, F.lit("")), F.lit(""))


def recent(items: DataFrame, date: str, today: str, days: int = 30) -> DataFrame:
    """Items of the last ``days`` days, today included; later dates and '' are not recent."""
    end = F.to_date(F.lit(today))
    return items.where(F.col(date).between(F.date_format(F.date_sub(end, days - 1), "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd")))


def related(items: DataFrame, key: str, tags: str, order: list[Column], most: int = 5) -> DataFrame:
    """(key, other, n): for each item the first ``most`` others, in a global order, that share a tag.

    Items are ranked once.  Of every tag only the first ``most + 1`` items can be among anyone's
    first ``most`` partners (an item has itself at most once among them), so each tag is a list of
    fixed length and the self-join over tags stays linear, however common a tag is.
    """
    ranked = items.select(key, F.array_distinct(F.coalesce(F.col(tags), F.array().cast("array<string>"))).alias("tags"), F.struct(*order).alias("place"))
    exploded = ranked.select(key, "place", F.explode("tags").alias("tag"))
    heads = exploded.withColumn("n", F.row_number().over(W.partitionBy("tag").orderBy("place", key))).where(F.col("n") <= most + 1).select("tag", F.col(key).alias("other"), F.col("place").alias("at"))
    pairs = exploded.join(heads, "tag").where(F.col(key) != F.col("other")).select(key, "other", "at").distinct()
    return pairs.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("at", "other"))).where(F.col("n") <= most).select(key, "other", "n")


def facet_values(items: DataFrame, column: Column) -> DataFrame:
    """(value, n) of every distinct non-empty value."""
    return items.select(column.alias("value")).where("value IS NOT NULL AND value != ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def between_dates(items: DataFrame, key: str, keys: list, date: str, since: str, until: str) -> DataFrame:
    """Items of a given list of keys dated within the bounds, in order of date and key."""
    return items.where(F.col(key).isin(*keys) & F.col(date).between(since, until)).orderBy(date, key)


def issuer_name(issuer: Column, host: Column, title: Column, hosts: dict[str, str], titled: dict[str, tuple[str, str]] | None = None, unknown: str = "未提供") -> Column:
    """The issuer; where there is none the organisation of the page's host.

    titled: for hosts of several organisations, the part of a title that names one and its name.
    """
    name = F.lit(unknown)
    for known, organisation in hosts.items():
        name = F.when(host == known, organisation).otherwise(name)
    for known, (part, organisation) in (titled or {}).items():
        name = F.when((host == known) & F.contains(F.coalesce(title, F.lit("")), F.lit(part)), organisation).otherwise(name)
    return F.coalesce(F.nullif(issuer, F.lit("")), name)
