"""Merging repeated observations: versions, memberships, counters and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import json_string
from loomwright.operators import scan


def version_history(checks: DataFrame, key: str, order: list[Column], failed: Column, content: str, attachments: str, chunk: Column | None = None, files: str | None = None) -> DataFrame:
    """Every check with ``event`` and ``change_type``, compared with the key's last good state.

    new: first check of a key; failed: a failed check (it never replaces a good state); unchanged;
    updated, with change_type recovery (only failures stood before), content, attachments, or, where
    ``files`` names the column of the files' own keys (``binary_keys``), parser_output for attachments
    that changed in nothing but what was read from them.  Checks stated twice should be removed first.
    Null hashes compare as equal.  ``chunk`` cuts keys of very many checks (see ``scan``).
    """
    flagged = checks.withColumn("_bad", F.coalesce(failed, F.lit(False)))
    state = F.when(~F.col("_bad"), F.struct(F.col(content).alias("c"), F.col(attachments).alias("a"), (F.col(files) if files else F.lit(None).cast("string")).alias("f")))
    seen = scan.last_values(flagged, [key], order, {"_was": state, "_before": F.lit(True)}, chunk)
    same_text, same_files = F.col(content).eqNullSafe(F.col("_was.c")), F.col(attachments).eqNullSafe(F.col("_was.a"))
    first, recovered = F.col("_before").isNull(), F.col("_was").isNull() & F.col("_before").isNotNull()
    event = F.when(F.col("_bad"), "failed").when(first, "new").when(recovered, "updated").when(same_text & same_files, "unchanged").otherwise("updated")
    reread = F.col(files).eqNullSafe(F.col("_was.f")) if files else F.lit(False)
    change = F.when(F.col("_bad") | first, None).when(recovered, "recovery").when(~same_text, "content").when(~same_files & reread, "parser_output").when(~same_files, "attachments")
    return seen.withColumn("event", event).withColumn("change_type", change).drop("_bad", "_was", "_before")


def event_counts(events: DataFrame, by: list[str], kinds: list[str], event: str = "event") -> DataFrame:
    """One row for each key with a count for every kind, 0 where there is none."""
    return events.groupBy(*by).agg(*[F.count_if(F.col(event) == k).alias(f"n_{k}") for k in kinds])


def failure_runs(rows: DataFrame, key: str, order: list[Column], failed: Column, at: str, chunk: Column | None = None) -> DataFrame:
    """Every row with ``failures`` (consecutive ones up to it, 0 on success) and ``last_success`` (so far).

    Failures are the running count of failures less that count at the last success; ``chunk`` cuts
    keys of very many rows (see ``scan``).
    """
    flagged = rows.withColumn("_bad", F.coalesce(failed, F.lit(False)))
    counted = scan.running_sums(flagged, [key], order, {"_so_far": F.col("_bad").cast("long")}, chunk)
    good = ~F.col("_bad")
    seen = scan.last_values(counted, [key], order, {"_base": F.when(good, F.col("_so_far")), "last_success": F.when(good, F.col(at))}, chunk, inclusive=True)
    return seen.withColumn("failures", F.col("_so_far") - F.coalesce("_base", F.lit(0))).drop("_bad", "_so_far", "_base")


def latest_members(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """(key, columns) of the newest row of every key: an upsert, combined before the shuffle."""
    newest = F.max(F.struct(*order, *columns)).alias("_m")
    return rows.groupBy(*key).agg(newest).select(*key, *[F.col(f"_m.{c}").alias(c) for c in columns])


def first_values(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, columns) of the oldest row of every key."""
    oldest = F.min(F.struct(*order, *columns)).alias("_m")
    return rows.groupBy(key).agg(oldest).select(key, *[F.col(f"_m.{c}").alias(c) for c in columns])


def attachment_digest(attachments: Column) -> Column:
    """SHA-256 over the JSON array of the sorted [url, sha256, status, text] of a record's attachments, independent of their order.

    Byte for byte what Python's ``json.dumps(..., ensure_ascii=False)`` gives; a null text counts as ''.
    No attachments, null or empty, give the digest of ``[]``.
    """
    rows = F.transform(attachments, lambda a: F.struct(a["url"].alias("u"), a["sha256"].alias("s"), a["status"].alias("k"), F.coalesce(a["text"], F.lit("")).alias("t")))
    each = F.transform(F.array_sort(rows), lambda r: F.concat(F.lit("["), F.concat_ws(", ", *[json_string(r[c]) for c in "uskt"]), F.lit("]")))
    return F.sha2(F.concat(F.lit("["), F.coalesce(F.array_join(each, ", "), F.lit("")), F.lit("]")), 256)


def binary_keys(attachments: Column) -> Column:
    """Sorted (url, sha256) of a record's attachments, as one string each: what tells changed files from changed texts."""
    return F.array_sort(F.transform(attachments, lambda a: F.concat_ws(" ", a["url"], F.coalesce(a["sha256"], F.lit("")))))


def distinct_in_order(rows: DataFrame, column: str, position: str) -> DataFrame:
    """(column, position): distinct values at the place of their first appearance."""
    return rows.groupBy(column).agg(F.min(position).alias(position))


def union_of_arrays(rows: DataFrame, by: str, column: str) -> DataFrame:
    """(by, column): sorted distinct union of an array column; values meet one by one, not as arrays."""
    each = rows.select(by, F.explode(column).alias("_v")).distinct()
    return each.groupBy(by).agg(F.array_sort(F.collect_list("_v")).alias(column))


def health_after(stats: DataFrame, previous: DataFrame, key: str, run: str, at: str) -> DataFrame:
    """(key, last_run_id, last_success_at, consecutive_failures, status) after a run.

    stats: (key, ok, pending) of the columns of the run; previous: (key, last_success_at,
    consecutive_failures).  Failures start again at 0 on success; a success with nothing pending moves
    ``last_success_at``; status is ok, pending or degraded.
    """
    both = stats.join(previous.select(key, "last_success_at", "consecutive_failures"), key, "left")
    success = F.when(F.col("ok") & ~F.col("pending"), F.lit(at)).otherwise(F.col("last_success_at"))
    failures = F.when(F.col("ok"), 0).otherwise(F.coalesce("consecutive_failures", F.lit(0)) + 1)
    status = F.when(~F.col("ok"), "degraded").when(F.col("pending"), "pending").otherwise("ok")
    return both.select(key, F.lit(run).alias("last_run_id"), success.alias("last_success_at"), failures.cast("long").alias("consecutive_failures"), status.alias("status"))
