"""Time series: as-of lookups, deltas, segments, scaling and validation.

Windows without a partition run in one task, so those functions take ``by``; without it they are
meant for one series of days or months (some ten thousand points at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwright.operators import scan


def _over(by: list[str], order: str):
    return (W.partitionBy(*by) if by else W.partitionBy()).orderBy(order)


def daily(rows: DataFrame, day: Column, value: Column, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """(by, day, value): the mean of each day."""
    return rows.groupBy(*(by or []), day.alias("day")).agg(F.round(F.avg(value), digits).alias("value"))


def as_of_change(series: DataFrame, back_days: int = 30, by: list[str] | None = None) -> DataFrame:
    """(by, latest day and value, target day, baseline day and value, change_pct): the latest point against the last one at or before ``back_days`` earlier.

    Two aggregations, no sort; change_pct is null without a baseline.
    """
    by = by or []
    last = series.groupBy(*by).agg(F.max("day").alias("latest_day"), F.max_by("value", "day").alias("latest_value"))
    joined = series.join(last, by) if by else series.crossJoin(F.broadcast(last))
    target = F.date_sub("latest_day", back_days)
    at = F.when(F.col("day") <= target, F.struct("day", "value"))
    best = joined.groupBy(*by, "latest_day", "latest_value").agg(F.max(at).alias("b"))
    pct = F.round((F.col("latest_value") / F.col("b.value") - 1) * 100, 4)
    return best.select(*by, "latest_day", "latest_value", target.alias("target_day"), F.col("b.day").alias("baseline_day"), F.col("b.value").alias("baseline_value"), pct.alias("change_pct"))


def as_of_join(left: DataFrame, right: DataFrame, at: str, by: list[str], value: str, chunk: Column | None = None) -> DataFrame:
    """Every left row with ``asof_at`` and the value of the right row with the largest ``at`` not after it, per key.

    Both sides are put in one sorted stream per key (union, then the last right value so far), so no
    pair of rows is ever compared; ties: a right row at the same instant counts.  ``chunk`` cuts keys
    of very many rows along ``at`` (see ``scan``).
    """
    l = left.select(*by, at, F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))  # noqa: E741
    r = right.select(*by, at, F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    seen = F.when(F.col("_side") == 0, F.struct(F.col(at).alias("at"), F.col("_value").alias("value")))
    so_far = scan.last_values(l.unionByName(r), by, [F.col(at), F.col("_side")], {"_b": seen}, chunk, inclusive=True)
    return so_far.where("_side = 1").select("_row.*", F.col("_b.at").alias("asof_at"), F.col("_b.value").alias(f"asof_{value}"))


def deltas(series: DataFrame, at: str, value: str, by: list[str] | None = None) -> DataFrame:
    """The series with ``previous``, ``delta`` and ``pct`` against the point before (null where there is none, or it is 0)."""
    before = F.lag(value).over(_over(by or [], at))
    return series.withColumn("previous", before).withColumn("delta", F.round(F.col(value) - F.col("previous"), 6)).withColumn("pct", F.round(F.try_divide(F.col(value) - F.col("previous"), F.col("previous")) * 100, 4))


def segments(series: DataFrame, at: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, at, value, segment, points): runs of non-null points; a null ends a run, a run of one point is isolated."""
    by = by or []
    gaps = F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)).over(_over(by, at).rowsBetween(W.unboundedPreceding, W.currentRow))
    kept = series.withColumn("_gap", gaps).where(F.col(value).isNotNull())
    sized = kept.withColumn("points", F.count(F.lit(1)).over(W.partitionBy(*by, "_gap")))
    return sized.withColumn("segment", F.dense_rank().over(_over(by, "_gap"))).drop("_gap").select(*by, at, value, F.col("segment").cast("long").alias("segment"), "points")


def scaled(series: DataFrame, value: str, height: float = 200.0, top: float = 20.0) -> DataFrame:
    """The series with ``y``: its value on an axis padded by an eighth of the range (12 %), at least 1 % of the maximum and 1; larger values are higher up."""
    bounds = series.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    pad = F.greatest((F.col("_high") - F.col("_low")) * 0.12, F.abs(F.col("_high")) * 0.01, F.lit(1.0))
    low, high = F.col("_low") - pad, F.col("_high") + pad
    y = F.round(F.lit(top) + (high - F.col(value)) / (high - low) * height, 4)
    return series.crossJoin(F.broadcast(bounds)).withColumn("y", y).drop("_low", "_high")


def ticks(series: DataFrame, value: str, n: int = 5) -> DataFrame:
    """(tick, at): ``n`` evenly spaced values of the padded axis."""
    bounds = series.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    pad = F.greatest((F.col("high") - F.col("low")) * 0.12, F.abs(F.col("high")) * 0.01, F.lit(1.0))
    step = (F.col("high") - F.col("low") + 2 * pad) / (n - 1)
    return bounds.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), (F.col("low") - pad).alias("a"), step.alias("s")).select(F.col("i").cast("long").alias("tick"), F.round(F.col("a") + F.col("i") * F.col("s"), 4).alias("at"))


def window_of(rows: DataFrame, day: str, as_of: str, days: int = 365) -> DataFrame:
    """Rows from ``days`` before the given day to that day, both included."""
    end = F.to_date(F.lit(as_of))
    return rows.where(F.col(day).between(F.date_sub(end, days), end))


def validation(rows: DataFrame, day: str, value: str, as_of: str, least_points: int = 150, first_within: int = 20, days: int = 365) -> DataFrame:
    """One row of checks over a price window: points, bad values, days with conflicting values, whether history is long enough."""
    inside = window_of(rows, day, as_of, days)
    v = F.col(value)
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v > 0)
    by_day = inside.groupBy(day).agg(F.count_if(~good).alias("bad"), (F.min(value) != F.max(value)).alias("conflict"))
    start = F.date_sub(F.to_date(F.lit(as_of)), days)
    checks = by_day.agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_values"), F.count_if("conflict").alias("conflicts"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    enough = (F.col("points") >= least_points) & (F.col("first_day") <= F.date_add(start, first_within))
    return checks.select("*", F.coalesce(enough & (F.col("bad_values") == 0) & (F.col("conflicts") == 0), F.lit(False)).alias("valid"))


def not_older(checks: DataFrame, previous_last: str | None) -> DataFrame:
    """The row of ``validation`` with ``fresh``: whether the series ends no earlier than the one it would replace; ``valid`` asks for that too."""
    fresh = F.lit(True) if previous_last is None else F.coalesce(F.col("last_day") >= F.to_date(F.lit(previous_last)), F.lit(False))
    return checks.withColumn("fresh", fresh).withColumn("valid", F.col("valid") & F.col("fresh"))


def spreads(rows: DataFrame, sharp: Column, peak: Column, valley: Column, listed: Column, unit: int = 100, digits: int = 4) -> DataFrame:
    """Rows with ``peak_spread`` and ``sharp_spread`` in the larger unit; the sharp one only where it applies to the whole period."""
    wide = lambda high: F.round((high - valley) / unit, digits)
    return rows.withColumn("peak_spread", wide(peak)).withColumn("sharp_spread", F.when(F.coalesce(listed, F.lit(False)), wide(sharp)))


def date_axis(series: DataFrame, day: str, left: float, width: float, by: list[str] | None = None) -> DataFrame:
    """The series with ``x``: its day on a linear axis from its first day to its last."""
    by = by or []
    bounds = series.groupBy(*by).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    joined = series.join(bounds, by) if by else series.crossJoin(F.broadcast(bounds))
    share = F.datediff(day, "_first") / F.greatest(F.lit(1), F.datediff("_last", "_first"))
    return joined.withColumn("x", F.round(F.lit(left) + share * width, 2)).drop("_first", "_last")


def either(series: DataFrame, columns: list[str]) -> DataFrame:
    """Points with a value in at least one of the columns."""
    return series.where(F.coalesce(*columns).isNotNull())
