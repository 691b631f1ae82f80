"""Operations inside a record's nested arrays, without exploding them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pruned(members: Column, field: str, allowed: list[str]) -> Column:
    """The members whose field is among the allowed values, in their order; null stays null."""
    return F.filter(members, lambda m: m[field].isin(*allowed))


def any_of(members: Column, field: str, allowed: list[str]) -> Column:
    """Whether some member's field is among the allowed values."""
    return F.coalesce(F.exists(members, lambda m: m[field].isin(*allowed)), F.lit(False))


def upserted(old: Column, new: Column, fields: list[str]) -> Column:
    """Old members overridden by new ones with the same key fields, sorted by those fields; null is an empty array."""
    key = lambda m: F.struct(*[m[f] for f in fields])
    taken = F.transform(F.coalesce(new, F.filter(old, lambda _: F.lit(False))), key)
    kept = F.filter(old, lambda m: ~F.array_contains(taken, key(m)))
    both = F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.concat(kept, new))
    return F.array_sort(both, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def without_repeats(members: Column, field: str) -> Column:
    """Members with a value of the field that no earlier member has."""
    seen = F.transform(members, lambda m: m[field])
    return F.filter(members, lambda m, i: (i == 0) | ~F.array_contains(F.slice(seen, 1, i), m[field]))


def with_metadata(attachments: Column, body: Column, base: str) -> Column:
    """Attachments with the files a metadata object (JSON: id, name, path) tells of; without an object, as they are."""
    told = F.from_json(body, "id string, name string, path string")
    url = F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(told["path"], "^/+", ""))
    extra = F.array(F.struct(told["name"].alias("name"), url.alias("url"), F.lit("pending").alias("status")))
    plain = F.transform(attachments, lambda a: F.struct(a["name"].alias("name"), a["url"].alias("url"), a["status"].alias("status")))
    return F.when(told["path"].isNull(), plain).otherwise(F.concat(F.coalesce(plain, F.filter(extra, lambda _: F.lit(False))), extra))


def edge_lines(text: Column, n: int = 2) -> Column:
    """The first and the last ``n`` lines that are not blank (each line once)."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.trim(line)) > 0)
    return F.when(F.size(lines) <= 2 * n, lines).otherwise(F.concat(F.slice(lines, 1, n), F.slice(lines, -n, n)))


def entry_order(date: str, position: str) -> list[Column]:
    """Newest first, undated entries before all others (a pinned entry must not end a backfill), ties by position."""
    return [F.desc_nulls_first(date), F.asc(position)]


def candidate_page(text: Column, links: Column, markers: list[str], least_chars: int = 100, least_links: int = 3) -> Column:
    """Whether a fetched page can be a real list page: enough text and links, and none of the markers of block pages."""
    blocked = F.lit(False)
    for marker in markers:
        blocked = blocked | F.contains(F.lower(text), F.lit(marker.lower()))
    return F.coalesce((F.length(text) >= least_chars) & (links >= least_links) & ~blocked, F.lit(False))


def membership(column: dict[str, Column], entry: dict[str, Column]) -> Column:
    """The membership of an entry in a column: ids and address of the column, dates and title the list gave the entry."""
    fields = [(column, "source_id", "source_id"), (column, "column_id", "column_id"), (column, "list_url", "url"), (entry, "list_date", "list_date"), (entry, "list_date_raw", "list_date_raw"), (entry, "list_title", "title")]
    return F.struct(*[side.get(source, F.lit(None)).cast("string").alias(name) for side, name, source in fields])
