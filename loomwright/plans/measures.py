"""Queries over time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import series
from loomwright.session import table


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))


def _daily(spark, d, by=None):
    return series.daily(_orders(spark, d), F.col("day"), F.col("o_totalprice"), by)


def _text(df, *columns):
    """Days as text, so that both engines show them alike."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


def asof_change(spark, d):
    return _text(series.as_of_change(_daily(spark, d, ["o_orderpriority"]), 30, ["o_orderpriority"]), "latest_day", "target_day", "baseline_day").withColumn("change_pct", F.round("change_pct", 3))


def asof_all_days(spark, d):
    days = _daily(spark, d, ["o_orderpriority"])
    left = days.where("dayofweek(day) = 2").select("o_orderpriority", "day", F.col("value").alias("own"))
    right = days.where("dayofmonth(day) % 5 = 0").select("o_orderpriority", "day", "value")
    return _text(series.as_of_join(left, right, "day", ["o_orderpriority"], "value", F.trunc("day", "year")), "day", "asof_at")


def month_deltas(spark, d):
    monthly = _orders(spark, d).groupBy("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return series.deltas(monthly, "month", "value", ["o_orderstatus"]).select("o_orderstatus", "month", "value", F.round("delta", 2).alias("delta"), F.round("pct", 2).alias("pct"))


def _purchases(spark, d):
    """Hourly counts of each event type, unknown where the hour had few."""
    counts = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("event_type", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.when(F.col("n") % 3 != 0, F.col("n")).alias("n"))


def gap_segments(spark, d):
    return series.segments(_purchases(spark, d), "hour", "n", ["event_type"])


def minmax_scale(spark, d):
    return _text(series.scaled(_daily(spark, d), "value"), "day").select("day", "y")


def axis_ticks(spark, d):
    return series.ticks(_daily(spark, d), "value").select("tick", F.round("at", 2).alias("at"))


def series_validate(spark, d):
    rows = _orders(spark, d).select("day", F.when(F.col("o_orderkey") % 997 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"))
    return _text(series.validation(rows, "day", "price", "1998-06-30"), "first_day", "last_day")


def price_window(spark, d):
    return _text(series.window_of(_daily(spark, d), "day", "1998-06-30"), "day")


_DAILY = "SELECT {by} o_orderdate::DATE AS day, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY ALL"
_BY = _DAILY.format(by="o_orderpriority,")
_ALL = _DAILY.format(by="")
_AXIS = "least_v AS (SELECT min(value) AS lo, max(value) AS hi FROM s), ax AS (SELECT lo - pad AS lo, hi + pad AS hi FROM (SELECT *, greatest((hi - lo) * 0.12, abs(hi) * 0.01, 1.0) AS pad FROM least_v))"
_D = "strftime({0}, '%Y-%m-%d') AS {0}"

QUERIES = {f.__name__: f for f in (asof_change, asof_all_days, month_deltas, gap_segments, minmax_scale, axis_ticks, series_validate, price_window)}

SQL = {
    "asof_change": f"""
        WITH s AS ({_BY}), l AS (SELECT o_orderpriority, max(day) AS latest_day, arg_max(value, day) AS latest_value FROM s GROUP BY 1),
        b AS (SELECT s.o_orderpriority, max(day) AS baseline_day, arg_max(value, day) AS baseline_value FROM s JOIN l USING (o_orderpriority) WHERE day <= latest_day - 30 GROUP BY 1)
        SELECT o_orderpriority, {_D.format('latest_day')}, latest_value, strftime(latest_day - 30, '%Y-%m-%d') AS target_day, {_D.format('baseline_day')}, baseline_value,
            round(round((latest_value / baseline_value - 1) * 100, 4), 3) AS change_pct FROM l LEFT JOIN b USING (o_orderpriority)""",
    "asof_all_days": f"""
        WITH s AS ({_BY}), r AS (SELECT o_orderpriority, day AS asof_at, value AS asof_value FROM s WHERE day(day) % 5 = 0), l AS (SELECT o_orderpriority, day, value AS own FROM s WHERE dayofweek(day) = 1)
        SELECT l.o_orderpriority, {_D.format('day')}, own, {_D.format('asof_at')}, asof_value FROM l ASOF LEFT JOIN r ON l.o_orderpriority = r.o_orderpriority AND l.day >= r.asof_at""",
    "month_deltas": """
        WITH m AS (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2),
        p AS (SELECT *, lag(value) OVER (PARTITION BY o_orderstatus ORDER BY month) AS previous FROM m)
        SELECT o_orderstatus, month, value, round(value - previous, 2) AS delta, round(round((value - previous) / previous * 100, 4), 2) AS pct FROM p""",
    "gap_segments": """
        WITH c AS (SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS k FROM events GROUP BY 1, 2), s AS (SELECT event_type, hour, CASE WHEN k % 3 <> 0 THEN k END AS n FROM c),
        g AS (SELECT *, sum((n IS NULL)::INT) OVER (PARTITION BY event_type ORDER BY hour ROWS UNBOUNDED PRECEDING) AS gap FROM s), v AS (SELECT * FROM g WHERE n IS NOT NULL)
        SELECT event_type, hour, n, dense_rank() OVER (PARTITION BY event_type ORDER BY gap) AS segment, count(*) OVER (PARTITION BY event_type, gap) AS points FROM v""",
    "minmax_scale": f"WITH s AS ({_ALL}), {_AXIS} SELECT {_D.format('day')}, round(20 + (ax.hi - value) / (ax.hi - ax.lo) * 200, 4) AS y FROM s, ax",
    "axis_ticks": f"WITH s AS ({_ALL}), {_AXIS} SELECT i AS tick, round(round(lo + i * (hi - lo) / 4, 4), 2) AS at FROM ax, range(5) t(i)",
    "series_validate": """
        WITH r AS (SELECT o_orderdate::DATE AS day, CASE WHEN o_orderkey % 997 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice END AS price FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1998-06-30' - 365 AND DATE '1998-06-30'),
        g AS (SELECT day, count(*) FILTER (price IS NULL OR isnan(price) OR isinf(price) OR price <= 0) AS bad, min(price) <> max(price) AS conflict FROM r GROUP BY day),
        c AS (SELECT count(*) AS points, coalesce(sum(bad), 0)::BIGINT AS bad_values, count(*) FILTER (conflict) AS conflicts, min(day) AS f, max(day) AS l FROM g)
        SELECT points, bad_values, conflicts, strftime(f, '%Y-%m-%d') AS first_day, strftime(l, '%Y-%m-%d') AS last_day,
            coalesce(points >= 150 AND f <= DATE '1998-06-30' - 345 AND bad_values = 0 AND conflicts = 0, false) AS valid FROM c""",
    "price_window": f"WITH s AS ({_ALL}) SELECT {_D.format('day')}, value FROM s WHERE day BETWEEN DATE '1998-06-30' - 365 AND DATE '1998-06-30'",
}
