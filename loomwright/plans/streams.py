"""Streams run to their end over the tables, to the results of the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.streaming import upsert


def stream_upsert(spark, d):
    rows = upsert.read_stream(spark, f"{d}/policy_checks.parquet").select("id", "column_id", "arrived_at", "check_id", "content_status")
    return upsert.run_upsert(rows, ["id", "column_id"], ["arrived_at", "check_id"]).select("id", "column_id", "check_id", "content_status")


def stream_windows(spark, d):
    counts = upsert.run_windows(upsert.read_stream(spark, f"{d}/events.parquet"), "ts", ["event_type"], "1 day")
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_failures(spark, d):
    rows = upsert.read_stream(spark, f"{d}/policy_checks.parquet").where("column_id IS NOT NULL").select("column_id", "check_id", (F.coalesce("content_status", F.lit("")) == "failed").alias("bad"))
    return upsert.run_states(rows, "column_id", "check_id", "bad").select("column_id", "failures", "last_success")


QUERIES = {f.__name__: f for f in (stream_upsert, stream_windows, stream_failures)}

SQL = {
    "stream_upsert": "SELECT id, column_id, check_id, content_status FROM policy_checks QUALIFY row_number() OVER (PARTITION BY id, column_id ORDER BY arrived_at DESC, check_id DESC) = 1",
    "stream_failures": """
        WITH s AS (SELECT column_id, max(check_id) FILTER (content_status IS DISTINCT FROM 'failed') AS last_success FROM policy_checks WHERE column_id IS NOT NULL GROUP BY 1)
        SELECT s.column_id, count(DISTINCT check_id) FILTER (content_status = 'failed' AND (last_success IS NULL OR check_id > last_success)) AS failures, any_value(last_success) AS last_success
        FROM s JOIN policy_checks USING (column_id) GROUP BY 1""",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
