"""Exact duplicate groups and the canonical member of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwright.functions.text import compact, plain_title


def latest_per_id(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key: the first in the given order (ties need a total order). Null keys are one key."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def group_key(title: Column, date: Column, own: Column) -> Column:
    """Title and date of a dated record; its own id where the date is missing, so that it stays alone."""
    dated = date.isNotNull() & (date != "")
    return F.when(dated, F.struct(F.lit("dated").alias("kind"), title.alias("a"), date.alias("b"))).otherwise(F.struct(F.lit("own").alias("kind"), own.alias("a"), F.lit("").alias("b")))


def with_priority(policies: DataFrame, completed: DataFrame, title: Column | None = None) -> DataFrame:
    """(group, id, row, p): p orders a group's members, the smallest is canonical.

    completed: (id) of records with a finished analysis.  They come first, then complete bodies, then
    more text, then the smaller id; the row id breaks ties of one id.
    """
    chars = F.length(F.coalesce(compact(F.col("content_text")), F.lit("")))
    order = F.struct(F.col("done").isNull().alias("open"), (~F.coalesce(F.col("content_status") == "complete", F.lit(False))).alias("cut"), (-chars).alias("chars"), F.col("id").alias("own"), F.col("record_id").alias("row"))
    key = group_key(plain_title(F.col("title")) if title is None else title, F.col("publish_date"), F.concat_ws("#", F.col("id"), F.col("record_id").cast("string")))
    return policies.join(completed.select("id", F.lit(True).alias("done")).distinct(), "id", "left").select(key.alias("grp"), "id", "record_id", "url", "column_ids", order.alias("p"))


def canonical(policies: DataFrame, completed: DataFrame, title: Column | None = None) -> DataFrame:
    """(record_id, id, canonical_record, canonical_id, members): every record with its group's canonical member.

    The canonical member is an aggregate of each group, joined back: a hot group is combined before
    the shuffle and never gathered in one task.
    """
    ranked = with_priority(policies, completed, title)
    best = ranked.groupBy("grp").agg(F.min("p").alias("best"), F.count(F.lit(1)).alias("members"))
    return ranked.join(best, "grp").select("record_id", "id", F.col("best.row").alias("canonical_record"), F.col("best.own").alias("canonical_id"), "members")


def groups(policies: DataFrame, completed: DataFrame) -> DataFrame:
    """(canonical_id, member_ids, source_links): members in order of priority.

    The arrays are the result that is asked for, so a group's ids and links meet in one row here.
    """
    ranked = with_priority(policies, completed)
    links = F.struct("p", F.struct("id", "url", "column_ids").alias("link"))
    gathered = ranked.groupBy("grp").agg(F.array_sort(F.collect_list(links), lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0)).alias("m"))
    return gathered.select(F.col("m")[0]["link"]["id"].alias("canonical_id"), F.transform("m", lambda x: x["link"]["id"]).alias("member_ids"), F.transform("m", lambda x: x["link"]).alias("source_links"))


def summary(policies: DataFrame, completed: DataFrame) -> DataFrame:
    """One row: groups, records, merged records."""
    counts = with_priority(policies, completed).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("merged"))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of key values that stand more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def last_by_position(rows: DataFrame, key: str, position: str, columns: list[str]) -> DataFrame:
    """(key, position, columns): the last value of every key, at the place where the key came first."""
    pick = F.max(F.struct(position, *columns)).alias("_last")
    return rows.groupBy(key).agg(F.min(position).alias(position), pick).select(key, position, *[F.col(f"_last.{c}").alias(c) for c in columns])
