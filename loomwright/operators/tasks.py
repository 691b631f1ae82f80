"""Scheduling of page tasks: boundaries, streaks, interleaving, rechecks and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators import scan


def since(entries: DataFrame, date: str, start: str) -> DataFrame:
    """Entries not dated before ``start``; undated ones stay."""
    return entries.where(F.col(date).isNull() | (F.col(date) >= start))


def before_boundary(entries: DataFrame, page: list[str], date: str, start: str) -> DataFrame:
    """(page, stop): whether every entry of a page is dated before ``start``."""
    return entries.groupBy(*page).agg(F.bool_and(F.coalesce(F.col(date) < start, F.lit(False))).alias("stop"))


def until_streak(rows: DataFrame, by: list[str], order: list[Column], known: Column, most: int, chunk: Column | None = None) -> DataFrame:
    """Rows of every key, with ``streak``, up to and with the one that completes the first run of ``most`` known rows.

    An unknown row ends a run.  The streak is the running count of known rows less that count at the
    last unknown row; ``chunk`` cuts keys of very many rows (see ``scan``).
    """
    flagged = rows.withColumn("_known", F.coalesce(known, F.lit(False)))
    counted = scan.running_sums(flagged, by, order, {"_so_far": F.col("_known").cast("long")}, chunk)
    at_unknown = scan.last_values(counted, by, order, {"_base": F.when(~F.col("_known"), F.col("_so_far"))}, chunk, inclusive=True)
    streaks = at_unknown.withColumn("streak", F.col("_so_far") - F.coalesce("_base", F.lit(0)))
    return scan.up_to_first(streaks, by, order, F.col("streak") >= most, inclusive=True).drop("_known", "_so_far", "_base")


def interleaved(tasks: DataFrame, host: Column, order: str, chunk: Column | None = None) -> DataFrame:
    """Tasks with ``round`` and ``host_place``: the first task of each host, then the second of each, hosts by first appearance.

    Sorting by (round, host_place) gives the schedule; ``chunk`` cuts hosts of very many tasks.
    """
    keyed = tasks.withColumn("_host", host)
    rounds = scan.running_sums(keyed, ["_host"], [F.col(order)], {"round": F.lit(1).cast("long")}, chunk)
    first = keyed.groupBy(F.col("_host").alias("_h")).agg(F.min(order).alias("host_place"))
    return rounds.join(first, F.col("_host").eqNullSafe(F.col("_h"))).drop("_host", "_h")


def recheck_due(rows: DataFrame, key: str, checked: Column, broken: Column, now: str, days: int, most: int) -> DataFrame:
    """The ``most`` rows longest unchecked among those broken or unchecked for ``days`` days; never checked ones come first."""
    due = F.coalesce(broken, F.lit(False)) | checked.isNull() | (checked < F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {int(days)} DAYS"))
    return rows.withColumn("checked", checked).where(due).orderBy(F.asc_nulls_first("checked"), key).limit(most)


def merged_tasks(pending: DataFrame, found: DataFrame, key: str, entry: list[str], member: str, order: str) -> DataFrame:
    """One task for each key of both tables: the entry of the newest row (found after pending), the union of memberships by ``member``."""
    both = pending.withColumn("_new", F.lit(0)).unionByName(found.withColumn("_new", F.lit(1)))
    # one membership for each (key, member) first, so that gathering them is bounded by the members there are
    each = both.groupBy(key, member).agg(F.max(F.struct("_new", order, *entry)).alias("last"))
    return each.groupBy(key).agg(F.max("last").alias("last"), F.array_sort(F.collect_list(member)).alias("members")).select(key, *[F.col(f"last.{c}").alias(c) for c in entry], "members")


def unseen(entries: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Entries whose key is not stored."""
    return entries.join(stored.select(key).distinct(), key, "left_anti")


def known_here(entries: DataFrame, stored: DataFrame, key: str, column: str, columns: str, usable: Column) -> DataFrame:
    """Entries with ``known``: stored, usable, and already listed under the entry's own column."""
    facts = stored.where(usable).select(key, F.explode(columns).alias(column)).distinct().withColumn("known", F.lit(True))
    return entries.join(facts, [key, column], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def resumed(pages: DataFrame, checkpoint: DataFrame, key: list[str]) -> DataFrame:
    """Pages that no checkpoint has passed."""
    return pages.join(checkpoint.select(*key).distinct(), key, "left_anti")


def batch(tasks: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The first ``size`` tasks in order; 0 takes all."""
    return tasks.orderBy(*order).limit(size) if size else tasks


def backfill_open(entries: DataFrame, stored: DataFrame, processed: DataFrame, key: str, broken: Column) -> DataFrame:
    """Entries a backfill still has to fetch: all but those processed before, stored, and stored without an error or open issue."""
    whole = stored.where(~F.coalesce(broken, F.lit(False))).select(key).distinct().join(processed.select(key).distinct(), key, "left_semi")
    return entries.join(whole, key, "left_anti")


def left_pending(pending: DataFrame, done: DataFrame, key: str, member: str, active: DataFrame) -> DataFrame:
    """(key, member) still pending: memberships of tasks that are done stay only under columns that were not active in the run."""
    return pending.join(done.select(key, F.lit(True).alias("_done")).distinct(), key, "left").join(active.select(member, F.lit(True).alias("_active")).distinct(), member, "left").where("_done IS NULL OR _active IS NULL").drop("_done", "_active")


def progress(columns: DataFrame, stored: DataFrame, tasks: DataFrame, column: str, key: str) -> DataFrame:
    """(column, stored_count, remaining, pending) of every column.

    stored: (key, column); tasks: (key, column, processed, checked).  remaining: discovered and not
    processed; pending: queued for this run and not checked.
    """
    kept = stored.select(column, key).distinct().groupBy(column).agg(F.count(F.lit(1)).alias("stored_count"))
    each = tasks.groupBy(column, key).agg(F.bool_or("processed").alias("p"), F.bool_or("checked").alias("c"))
    queued = each.groupBy(column).agg(F.count_if(~F.col("p")).alias("remaining"), F.count_if(~F.col("c")).alias("pending"))
    counts = columns.select(column).distinct().join(kept, column, "left").join(queued, column, "left")
    return counts.select(column, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("stored_count", "remaining", "pending")])


def newest_supplement(entries: DataFrame, column: str, columns: list[str], order: list[Column], key: str, most: int = 50) -> DataFrame:
    """The first ``most`` entries of each given column, each key once (the last mention in that order)."""
    from pyspark.sql import Window as W

    heads = entries.where(F.col(column).isin(*columns)).withColumn("_n", F.row_number().over(W.partitionBy(column).orderBy(*order))).where(F.col("_n") <= most)
    last = F.max(F.struct("_n", *[F.col(c) for c in entries.columns])).alias("_e")
    return heads.groupBy(key).agg(last).select(*[F.col(f"_e.{c}").alias(c) for c in entries.columns])
