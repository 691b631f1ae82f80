"""Queries over the log of checks and over tasks: streaks, schedules, versions, health and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import urls
from loomwright.operators import budget, dedup, merge, quality, screen, tasks
from loomwright.session import instant, table


def _p(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "policies")


def _checks(spark: SparkSession, d: str) -> DataFrame:
    """Each check once, as it arrived first."""
    rows = table(spark, d, "policy_checks")
    columns = [c for c in rows.columns if c not in ("check_id", "arrived_at")]
    return merge.first_values(rows, "check_id", ["arrived_at"], columns).withColumn("at", instant(F.col("last_checked_at")))


def _order():
    return [F.col("at"), F.col("check_id")]


def _day():
    """Chunks of a key's checks: one for each day, so that one id or column with a third of all checks is many tasks."""
    return F.to_date("at")


def _failed():
    return F.col("content_status") == "failed"


def since_filter(spark, d):
    return tasks.since(_p(spark, d), "list_date", "2025-01-01").select("record_id", "list_date")


def page_boundary(spark, d):
    return tasks.before_boundary(_p(spark, d), ["column_id"], "list_date", "2022-06-01").select("column_id", "stop")


def streak_stop(spark, d):
    rows = tasks.until_streak(_checks(spark, d), ["column_id"], _order(), F.col("content_status") == "complete", 6, _day())
    return rows.select("check_id", F.col("streak").cast("long").alias("streak"))


def round_robin(spark, d):
    return tasks.interleaved(_p(spark, d), urls.host(F.col("url")), "record_id", F.floor(F.col("record_id") / 100_000)).select("record_id", "round", "host_place")


def recheck_due(spark, d):
    broken = F.col("last_fetch_error").isNotNull() | (F.size("collection_issues") > 0)
    return tasks.recheck_due(_p(spark, d), "record_id", instant(F.col("last_checked_at")), broken, "2026-06-01 00:00:00", 7, 20).select("record_id", F.date_format("checked", "yyyy-MM-dd HH:mm:ss").alias("checked"))


def tasks_merged(spark, d):
    rows = _p(spark, d).where("url IS NOT NULL AND column_id IS NOT NULL").select("url", "title", "column_id", "record_id", "content_status")
    done = F.coalesce(F.col("content_status") == "complete", F.lit(False))
    merged = tasks.merged_tasks(rows.where(~done).drop("content_status"), rows.where(done).drop("content_status"), "url", ["title"], "column_id", "record_id")
    return merged.select("url", "title", F.array_join("members", "|").alias("members"))


def known_here(spark, d):
    entries = table(spark, d, "policy_checks").select("id", "column_id").distinct()
    usable = F.coalesce(F.col("content_status"), F.lit("")) != "failed"
    return tasks.known_here(entries, _p(spark, d), "id", "column_id", "column_ids", usable)


def unseen_checks(spark, d):
    return tasks.unseen(table(spark, d, "policy_checks").select("id").distinct(), _p(spark, d).where("content_status = 'complete'"), "id")


def version_history(spark, d):
    return merge.version_history(_checks(spark, d), "id", _order(), _failed(), "content_hash", "attachments_hash", _day()).select("check_id", "event", "change_type")


def event_counters(spark, d):
    events = merge.version_history(_checks(spark, d), "id", _order(), _failed(), "content_hash", "attachments_hash", _day())
    return merge.event_counts(events, ["column_id"], ["new", "updated", "unchanged", "failed"])


def consecutive_failures(spark, d):
    return merge.failure_runs(_checks(spark, d), "column_id", _order(), _failed(), "last_checked_at", _day()).select("check_id", F.col("failures").cast("long").alias("failures"), "last_success")


def membership_upsert(spark, d):
    rows = table(spark, d, "policy_checks")
    return merge.latest_members(rows, ["id", "column_id"], ["arrived_at", "check_id"], ["status", "content_status"]).select("id", "column_id", F.col("status").cast("long").alias("status"), "content_status")


def first_seen(spark, d):
    return merge.first_values(table(spark, d, "policy_checks"), "id", ["arrived_at", "check_id"], ["column_id", "source_id"])


def last_delivery(spark, d):
    return dedup.last_by_position(table(spark, d, "policy_checks").select("id", F.col("check_id").alias("at"), "content_status"), "id", "at", ["content_status"])


def ordered_distinct(spark, d):
    return merge.distinct_in_order(table(spark, d, "policy_checks"), "column_id", "check_id")


def duplicate_deliveries(spark, d):
    return dedup.repeated(table(spark, d, "policy_checks"), ["check_id"])


def column_health(spark, d):
    status = F.coalesce(F.col("content_status"), F.lit(""))
    return _checks(spark, d).groupBy("column_id").agg(F.bool_or(status == "failed").alias("any_failed"), F.bool_and(status == "complete").alias("all_complete"), F.max("attempt").cast("long").alias("most_attempts"), F.round(F.min("seconds"), 4).alias("fastest"), F.round(F.max("seconds"), 4).alias("slowest"))


def check_statuses(spark, d):
    status = F.col("status")
    return screen.flag_counts(table(spark, d, "policy_checks"), {"ok": status == 200, "client": status.between(400, 499), "server": status >= 500, "unknown": status.isNull()})


def missing_columns(spark, d):
    """Monitored columns without any record of images alone."""
    return quality.missing_from(table(spark, d, "column_health"), _p(spark, d).where("content_status = 'image_only'"), "column_id").select("column_id", "status")


def budget_admission(spark, d):
    rows = budget.admitted(_checks(spark, d), F.date_format("at", "yyyy-MM"), _order(), F.col("attempt").cast("decimal(12,4)") * F.lit("0.2").cast("decimal(4,2)"), "50", 230, _day())
    return rows.select("check_id", "period", F.col("reserved").cast("string").alias("reserved"))


def budget_by_month(spark, d):
    by = budget.reserved_by_period(_checks(spark, d), F.date_format("at", "yyyy-MM"), F.col("attempt").cast("decimal(12,4)") * F.lit("0.2").cast("decimal(4,2)"))
    return by.select("period", F.col("reserved").cast("decimal(14,4)").cast("string").alias("reserved"))


def running_limit(spark, d):
    return budget.within_running_limit(_checks(spark, d), ["column_id"], _order(), F.col("size_bytes"), 5_000_000, _day()).select("check_id", "running")


_C = """
    c AS (SELECT *, try_cast(last_checked_at AS TIMESTAMPTZ) AS seen_at FROM policy_checks
          QUALIFY row_number() OVER (PARTITION BY check_id ORDER BY arrived_at) = 1)"""
_O = "ORDER BY seen_at NULLS FIRST, check_id"
_EVENTS = f"""
    {_C}, s AS (SELECT *, content_status IS NOT DISTINCT FROM 'failed' AS bad,
            row_number() OVER (PARTITION BY id {_O}) AS n,
            last_value(CASE WHEN content_status IS DISTINCT FROM 'failed' THEN struct_pack(c := content_hash, a := attachments_hash) END IGNORE NULLS)
                OVER (PARTITION BY id {_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM c),
    e AS (SELECT *, CASE WHEN bad THEN 'failed' WHEN n = 1 THEN 'new' WHEN was IS NULL THEN 'updated'
                    WHEN content_hash IS NOT DISTINCT FROM was.c AND attachments_hash IS NOT DISTINCT FROM was.a THEN 'unchanged' ELSE 'updated' END AS event,
            CASE WHEN bad OR n = 1 THEN NULL WHEN was IS NULL THEN 'recovery' WHEN content_hash IS DISTINCT FROM was.c THEN 'content'
                 WHEN attachments_hash IS DISTINCT FROM was.a THEN 'attachments' END AS change_type FROM s)"""

QUERIES = {f.__name__: f for f in (
    since_filter, page_boundary, streak_stop, round_robin, recheck_due, tasks_merged, known_here, unseen_checks, version_history, event_counters, consecutive_failures, membership_upsert, first_seen, last_delivery,
    ordered_distinct, duplicate_deliveries, column_health, check_statuses, missing_columns, budget_admission, budget_by_month, running_limit,
)}

SQL = {
    "since_filter": "SELECT record_id, list_date FROM policies WHERE list_date IS NULL OR list_date >= '2025-01-01'",
    "page_boundary": "SELECT column_id, bool_and(coalesce(list_date < '2022-06-01', false)) AS stop FROM policies GROUP BY column_id",
    "streak_stop": f"""
        WITH {_C}, k AS (SELECT *, content_status IS NOT DISTINCT FROM 'complete' AS known, sum(CASE WHEN content_status IS NOT DISTINCT FROM 'complete' THEN 0 ELSE 1 END)
                OVER (PARTITION BY column_id {_O} ROWS UNBOUNDED PRECEDING) AS run FROM c),
        s AS (SELECT *, sum(known::INT) OVER (PARTITION BY column_id, run {_O} ROWS UNBOUNDED PRECEDING) AS streak, row_number() OVER (PARTITION BY column_id {_O}) AS n FROM k),
        f AS (SELECT column_id, min(n) AS stop FROM s WHERE streak >= 6 GROUP BY column_id)
        SELECT check_id, streak::BIGINT AS streak FROM s LEFT JOIN f ON f.column_id IS NOT DISTINCT FROM s.column_id WHERE n <= coalesce(stop, n)""",
    "round_robin": """
        WITH h AS (SELECT record_id, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1), '')) AS host FROM policies)
        SELECT record_id, row_number() OVER (PARTITION BY host ORDER BY record_id) AS round, min(record_id) OVER (PARTITION BY host) AS host_place FROM h""",
    "recheck_due": """
        SELECT record_id, strftime(t AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS checked FROM (SELECT *, try_cast(last_checked_at AS TIMESTAMPTZ) AS t FROM policies)
        WHERE last_fetch_error IS NOT NULL OR len(collection_issues) > 0 OR t IS NULL OR t < TIMESTAMPTZ '2026-05-25 00:00:00+00' ORDER BY t NULLS FIRST, record_id LIMIT 20""",
    "tasks_merged": """
        WITH r AS (SELECT url, title, column_id, record_id, CASE WHEN content_status = 'complete' THEN 1 ELSE 0 END AS new FROM policies WHERE url IS NOT NULL AND column_id IS NOT NULL),
        t AS (SELECT url, title FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY new DESC, record_id DESC) = 1),
        m AS (SELECT url, string_agg(column_id, '|' ORDER BY column_id) AS members FROM (SELECT DISTINCT url, column_id FROM r) GROUP BY url)
        SELECT url, title, members FROM t JOIN m USING (url)""",
    "known_here": """
        WITH f AS (SELECT DISTINCT id, unnest(column_ids) AS column_id FROM policies WHERE content_status IS DISTINCT FROM 'failed'), e AS (SELECT DISTINCT id, column_id FROM policy_checks)
        SELECT id, column_id, EXISTS (SELECT 1 FROM f WHERE f.id = e.id AND f.column_id = e.column_id) AS known FROM e""",
    "unseen_checks": "SELECT DISTINCT id FROM policy_checks c WHERE NOT EXISTS (SELECT 1 FROM policies p WHERE p.id = c.id AND p.content_status = 'complete')",
    "version_history": f"WITH {_EVENTS} SELECT check_id, event, change_type FROM e",
    "event_counters": f"""
        WITH {_EVENTS} SELECT column_id, count(*) FILTER (event = 'new') AS n_new, count(*) FILTER (event = 'updated') AS n_updated,
            count(*) FILTER (event = 'unchanged') AS n_unchanged, count(*) FILTER (event = 'failed') AS n_failed FROM e GROUP BY column_id""",
    "consecutive_failures": f"""
        WITH {_C}, r AS (SELECT *, content_status IS NOT DISTINCT FROM 'failed' AS bad, sum(CASE WHEN content_status IS NOT DISTINCT FROM 'failed' THEN 0 ELSE 1 END)
                OVER (PARTITION BY column_id {_O} ROWS UNBOUNDED PRECEDING) AS run FROM c)
        SELECT check_id, (sum(bad::INT) OVER (PARTITION BY column_id, run {_O} ROWS UNBOUNDED PRECEDING))::BIGINT AS failures,
            last_value(CASE WHEN NOT bad THEN last_checked_at END IGNORE NULLS) OVER (PARTITION BY column_id {_O} ROWS UNBOUNDED PRECEDING) AS last_success FROM r""",
    "membership_upsert": "SELECT id, column_id, status::BIGINT AS status, content_status FROM policy_checks QUALIFY row_number() OVER (PARTITION BY id, column_id ORDER BY arrived_at DESC, check_id DESC) = 1",
    "first_seen": "SELECT id, column_id, source_id FROM policy_checks QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at, check_id) = 1",
    "last_delivery": "SELECT id, min(check_id) AS at, arg_max(content_status, check_id) AS content_status FROM policy_checks GROUP BY id",
    "ordered_distinct": "SELECT column_id, min(check_id) AS check_id FROM policy_checks GROUP BY column_id",
    "duplicate_deliveries": "SELECT check_id, count(*) AS n FROM policy_checks GROUP BY check_id HAVING count(*) > 1",
    "column_health": f"""
        WITH {_C} SELECT column_id, bool_or(coalesce(content_status, '') = 'failed') AS any_failed, bool_and(coalesce(content_status, '') = 'complete') AS all_complete,
            max(attempt)::BIGINT AS most_attempts, round(min(seconds), 4) AS fastest, round(max(seconds), 4) AS slowest FROM c GROUP BY column_id""",
    "check_statuses": """
        SELECT count(*) FILTER (status = 200) AS ok, count(*) FILTER (status BETWEEN 400 AND 499) AS client, count(*) FILTER (status >= 500) AS server, count(*) FILTER (status IS NULL) AS unknown FROM policy_checks""",
    "missing_columns": "SELECT column_id, status FROM column_health h WHERE NOT EXISTS (SELECT 1 FROM policies p WHERE p.column_id = h.column_id AND p.content_status = 'image_only')",
    "budget_admission": f"""
        WITH {_C}, r AS (SELECT check_id, seen_at, strftime(seen_at AT TIME ZONE 'UTC', '%Y-%m') AS period, (attempt * 0.2)::DECIMAL(12,4) AS money FROM c),
        s AS (SELECT *, sum(coalesce(money, 0)) OVER (PARTITION BY period {_O} ROWS UNBOUNDED PRECEDING) AS reserved, row_number() OVER (PARTITION BY period {_O}) AS n FROM r),
        f AS (SELECT period, min(n) AS stop FROM s WHERE NOT (reserved <= 50 AND n <= 230) GROUP BY period)
        SELECT check_id, s.period, reserved::DECIMAL(22,4)::VARCHAR AS reserved FROM s LEFT JOIN f ON f.period IS NOT DISTINCT FROM s.period WHERE n < coalesce(stop, n + 1)""",
    "budget_by_month": f"WITH {_C} SELECT strftime(seen_at AT TIME ZONE 'UTC', '%Y-%m') AS period, sum((attempt * 0.2)::DECIMAL(12,4))::DECIMAL(14,4)::VARCHAR AS reserved FROM c GROUP BY 1",
    "running_limit": f"""
        WITH {_C}, r AS (SELECT check_id, (sum(coalesce(size_bytes, 0)) OVER (PARTITION BY column_id {_O} ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM c)
        SELECT check_id, running FROM r WHERE running <= 5000000""",
}
