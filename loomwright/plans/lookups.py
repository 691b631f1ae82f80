"""Small queries: local times, labels, query strings, resuming and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import dates, urls
from loomwright.functions.text import clean
from loomwright.operators import tasks
from loomwright.plans.incremental import to_analyse
from loomwright.session import instant, table
from loomwright.sources import provider, store

LABELS = {"complete": "完整", "partial": "部分", "image_only": "仅图片", "failed": "失败"}


def local_times(spark, d):
    return table(spark, d, "policy_checks").select("check_id", dates.local_time(F.col("last_checked_at")).alias("shown"), F.date_format(dates.as_of_day(instant(F.col("last_checked_at"))), "yyyy-MM-dd").alias("as_of")).distinct()


def status_labels(spark, d):
    return table(spark, d, "policies").select("record_id", dates.label(F.col("content_status"), LABELS).alias("label"))


def query_strings(spark, d):
    return table(spark, d, "policies").select("record_id", urls.query_parameters(F.col("url")).alias("q")).select("record_id", F.try_element_at("q", F.lit("utm_source")).alias("source"), F.size("q").cast("long").alias("parameters"))


def resumed_columns(spark, d):
    pages = table(spark, d, "policies").select("record_id", "column_id")
    done = table(spark, d, "column_health").where("status = 'ok'").select("column_id")
    return tasks.resumed(pages, done, ["column_id"]).select("record_id", "column_id")


def analysis_pending(spark, d):
    return to_analyse(table(spark, d, "policies"), table(spark, d, "analyses"))


def provider_readings(spark, d):
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    return provider.readings(rows, "doc_id", "text").select("doc_id", "answer", "input_hash")


def snapshot_overlay(spark, d):
    p = table(spark, d, "policies").select("record_id", "title", "content_status")
    update = p.where("content_status = 'complete'").withColumn("title", clean(F.col("title")))
    return store.overlay(p, update, ["record_id"]).select("record_id", "title")


def slim_index(spark, d):
    return store.slim_index(table(spark, d, "policies")).withColumn("column_ids", F.array_join("column_ids", "|"))


QUERIES = {f.__name__: f for f in (local_times, status_labels, query_strings, resumed_columns, analysis_pending, provider_readings, snapshot_overlay, slim_index)}

_T = "(try_cast(last_checked_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' + INTERVAL 8 HOURS)"
SQL = {
    "local_times": f"""
        SELECT DISTINCT check_id, CASE WHEN last_checked_at IS NULL OR last_checked_at = '' THEN '暂无记录' ELSE coalesce(strftime({_T}, '%Y-%m-%d %H:%M'), '时间无效') END AS shown,
            strftime(CASE WHEN hour({_T}) >= 16 THEN {_T}::DATE ELSE {_T}::DATE - 1 END, '%Y-%m-%d') AS as_of FROM policy_checks""",
    "status_labels": "SELECT record_id, CASE content_status WHEN 'complete' THEN '完整' WHEN 'partial' THEN '部分' WHEN 'image_only' THEN '仅图片' WHEN 'failed' THEN '失败' ELSE content_status END AS label FROM policies",
    "query_strings": r"""
        WITH q AS (SELECT record_id, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: contains(p, '=')) AS q FROM policies)
        SELECT record_id, regexp_extract(list_filter(q, lambda p: starts_with(p, 'utm_source='))[-1], '=(.*)$', 1) AS source,
            len(list_distinct(list_transform(q, lambda p: regexp_extract(p, '^([^=]*)=', 1)))) AS parameters FROM q""",
    "resumed_columns": "SELECT record_id, column_id FROM policies p WHERE NOT EXISTS (SELECT 1 FROM column_health h WHERE h.status = 'ok' AND h.column_id = p.column_id)",
    "analysis_pending": """
        WITH p AS (SELECT * FROM policies WHERE content_status IS DISTINCT FROM 'failed' QUALIFY row_number() OVER (PARTITION BY id ORDER BY try_cast(last_checked_at AS TIMESTAMPTZ) DESC NULLS LAST, record_id) = 1),
        h AS (SELECT id, sha256('["storage-rules-4", ' || coalesce(to_json(title)::VARCHAR, 'null') || ', ' || coalesce('"' || content_hash || '"', 'null') || ', ' || coalesce('"' || attachments_hash || '"', 'null') || ']') AS h FROM p)
        SELECT id FROM h WHERE NOT EXISTS (SELECT 1 FROM analyses a WHERE a.id = h.id AND a.input_hash = h.h AND a.status IN ('complete', 'irrelevant'))""",
    "provider_readings": "SELECT doc_id, string_split(text, '。')[1][1:50] AS answer, sha256(text) AS input_hash FROM documents WHERE text IS NOT NULL",
    "snapshot_overlay": r"""
        SELECT record_id, CASE WHEN content_status = 'complete' THEN trim(regexp_replace(coalesce(title, ''), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) ELSE title END AS title FROM policies""",
    "slim_index": "SELECT id, url, title, array_to_string(column_ids, '|') AS column_ids, list_date, content_status FROM policies",
}
