"""Admission under a budget and running limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators import scan


def admitted(calls: DataFrame, period: Column, order: list[Column], reserve: Column, cap: str, most: int, chunk: Column | None = None) -> DataFrame:
    """Calls admitted in order while the period's reservations stay within ``cap`` and at most ``most`` were made.

    The first call that does not fit ends its period: nothing after it is admitted.  Amounts are
    decimals, so a sum that meets the cap exactly is still admitted.  A null reservation counts as 0.
    """
    money = F.coalesce(reserve, F.lit(0)).cast("decimal(12,4)")
    summed = scan.running_sums(calls.withColumn("period", period), ["period"], order, {"reserved": money, "_n": F.lit(1).cast("long")}, chunk)
    over = (F.col("reserved") > F.lit(cap).cast("decimal(12,4)")) | (F.col("_n") > most)
    return scan.up_to_first(summed, ["period"], order, over, inclusive=False).drop("_n")


def within_running_limit(rows: DataFrame, by: list[str], order: list[Column], size: Column, limit: int, chunk: Column | None = None) -> DataFrame:
    """Rows of each key while the running sum of ``size`` stays within the limit."""
    return scan.running_sums(rows, by, order, {"running": size}, chunk).where(F.col("running") <= limit)


def reserved_by_period(ledger: DataFrame, period: Column, reserve: Column) -> DataFrame:
    """(period, reserved): reservations of each period, as decimals."""
    return ledger.groupBy(period.alias("period")).agg(F.sum(reserve.cast("decimal(12,4)")).alias("reserved"))
