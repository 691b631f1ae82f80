"""Queries inside nested arrays, chart paths and ordered entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import nested, series
from loomwright.session import table

COLUMNS = ["xznb_interpretations", "mhcn_interpretations", "qsfg_interpretations"]
MARKERS = ["验证码", "访问被拒绝", "captcha", "access denied"]


def _p(spark, d):
    return table(spark, d, "policies")


def pruned_memberships(spark, d):
    rows = _p(spark, d).where(nested.any_of(F.col("columns"), "column_id", COLUMNS))
    return rows.select("record_id", F.array_join(F.transform(nested.pruned(F.col("columns"), "column_id", COLUMNS), lambda m: m["column_id"]), "|").alias("kept"))


def nested_upsert(spark, d):
    """Memberships overridden by one for the record's own column."""
    p = _p(spark, d)
    new = F.array(F.struct(*[(F.col("source_id") if f.name == "source_id" else F.col("column_id") if f.name == "column_id" else F.lit("new") if f.name == "list_title" else F.lit(None).cast("string")).alias(f.name) for f in p.schema["columns"].dataType.elementType]))
    merged = nested.upserted(F.col("columns"), new, ["source_id", "column_id"])
    return p.select("record_id", F.array_join(F.transform(merged, lambda m: F.concat_ws(":", m["source_id"], m["column_id"], m["list_title"])), "|").alias("members"))


def distinct_attachments(spark, d):
    return _p(spark, d).where("attachments IS NOT NULL").select("record_id", F.array_join(F.transform(nested.without_repeats(F.col("attachments"), "format"), lambda a: F.concat_ws(":", a["format"], a["name"])), "|").alias("first_of_format"))


def edge_lines(spark, d):
    return _p(spark, d).where("content_text IS NOT NULL").select("record_id", F.array_join(nested.edge_lines(F.col("content_text")), "\n").alias("edges"))


def newest_entries(spark, d):
    return _p(spark, d).select("record_id", "list_date").orderBy(*nested.entry_order("list_date", "record_id")).limit(50)


def candidate_pages(spark, d):
    links = F.coalesce(F.size("attachments"), F.lit(0)) + F.coalesce(F.size("columns"), F.lit(0))
    return _p(spark, d).where(nested.candidate_page(F.col("content_text"), links, MARKERS, 100, 2)).select("record_id")


def chart_paths(spark, d):
    """Each event type's hourly counts as path commands: M at the start of a segment, L within it."""
    hours = table(spark, d, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n")).select("event_type", "hour", F.when(F.col("n") % 5 != 0, F.col("n")).alias("n"))
    points = series.segments(hours, "hour", "n", ["event_type"])
    starts = points.groupBy("event_type", "segment").agg(F.min("hour").alias("start"))
    command = F.struct("hour", F.concat(F.when(F.col("hour") == F.col("start"), "M").otherwise("L"), (65 + 60 * F.col("hour")).cast("string"), F.lit(","), F.col("n").cast("string")).alias("c"))
    drawn = points.join(starts, ["event_type", "segment"]).groupBy("event_type").agg(F.array_sort(F.collect_list(command)).alias("cs"))  # at most 24 points a type
    return drawn.select("event_type", F.array_join(F.transform("cs", lambda c: c["c"]), " ").alias("path"))


def series_ends(spark, d):
    """First, last and last but one value of each priority's daily mean."""
    s = series.daily(table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), F.col("day"), F.col("o_totalprice"), ["o_orderpriority"])
    last = s.groupBy("o_orderpriority").agg(F.min_by("value", "day").alias("first"), F.max_by("value", "day").alias("last"), F.max("day").alias("_at"))
    before = s.join(last, "o_orderpriority").where(F.col("day") < F.col("_at")).groupBy("o_orderpriority").agg(F.max_by("value", "day").alias("previous"))
    return last.drop("_at").join(before, "o_orderpriority", "left")


def failed_readings(spark, d):
    """Failed analyses of canonical records whose failure was no deferral."""
    a = table(spark, d, "analyses")
    finished = a.where("status IN ('complete', 'irrelevant')").select("id").distinct()
    deferred = F.contains(F.lower(F.coalesce("error", F.lit(""))), F.lit("budget"))
    return a.where((F.col("status") == "pending_review") & ~deferred).join(finished, "id", "left_anti").select("analysis_no")


QUERIES = {f.__name__: f for f in (pruned_memberships, nested_upsert, distinct_attachments, edge_lines, newest_entries, candidate_pages, chart_paths, series_ends, failed_readings)}

_COLUMNS = "[" + ", ".join(f"'{c}'" for c in COLUMNS) + "]"
SQL = {
    "pruned_memberships": f"""
        SELECT record_id, array_to_string(k, '|') AS kept FROM (SELECT record_id, list_transform(list_filter(columns, lambda m: list_contains({_COLUMNS}, m.column_id)), lambda m: m.column_id) AS k FROM policies) WHERE len(k) > 0""",
    "nested_upsert": """
        WITH m AS (SELECT record_id, source_id AS s, column_id AS c, unnest(columns) AS x FROM policies), k AS (
            SELECT record_id, x.source_id AS a, x.column_id AS b, x.list_title AS t FROM m WHERE NOT (x.source_id = s AND x.column_id = c)
            UNION ALL SELECT record_id, source_id, column_id, 'new' FROM policies)
        SELECT record_id, string_agg(concat_ws(':', a, b, t), '|' ORDER BY a, b) AS members FROM k GROUP BY record_id""",
    "distinct_attachments": """
        WITH a AS (SELECT record_id, unnest(attachments) AS a, unnest(range(1, len(attachments) + 1)) AS i FROM policies),
        f AS (SELECT record_id, a, i FROM a QUALIFY row_number() OVER (PARTITION BY record_id, a.format ORDER BY i) = 1)
        SELECT p.record_id, coalesce(string_agg(concat_ws(':', f.a.format, f.a.name), '|' ORDER BY i), '') AS first_of_format FROM policies p LEFT JOIN f ON f.record_id = p.record_id WHERE p.attachments IS NOT NULL GROUP BY 1""",
    "edge_lines": """
        WITH l AS (SELECT record_id, list_filter(string_split(content_text, chr(10)), lambda x: length(trim(x)) > 0) AS l FROM policies WHERE content_text IS NOT NULL)
        SELECT record_id, array_to_string(CASE WHEN len(l) <= 4 THEN l ELSE list_concat(l[1:2], l[-2:]) END, chr(10)) AS edges FROM l""",
    "newest_entries": "SELECT record_id, list_date FROM policies ORDER BY list_date DESC NULLS FIRST, record_id LIMIT 50",
    "candidate_pages": """
        SELECT record_id FROM policies WHERE length(content_text) >= 100 AND coalesce(len(attachments), 0) + coalesce(len(columns), 0) >= 2
            AND NOT regexp_matches(lower(content_text), '验证码|访问被拒绝|captcha|access denied')""",
    "chart_paths": """
        WITH c AS (SELECT event_type, hour(ts) AS hour, count(*) AS k FROM events GROUP BY 1, 2), s AS (SELECT event_type, hour, CASE WHEN k % 5 <> 0 THEN k END AS n FROM c),
        g AS (SELECT *, sum((n IS NULL)::INT) OVER (PARTITION BY event_type ORDER BY hour ROWS UNBOUNDED PRECEDING) AS gap FROM s), v AS (SELECT * FROM g WHERE n IS NOT NULL),
        p AS (SELECT event_type, hour, CASE WHEN hour = min(hour) OVER (PARTITION BY event_type, gap) THEN 'M' ELSE 'L' END || (65 + 60 * hour) || ',' || n AS c FROM v)
        SELECT event_type, string_agg(c, ' ' ORDER BY hour) AS path FROM p GROUP BY event_type""",
    "series_ends": """
        WITH s AS (SELECT o_orderpriority, o_orderdate::DATE AS day, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY day DESC) AS n FROM s)
        SELECT o_orderpriority, arg_min(value, day) AS first, arg_max(value, day) AS last, max(value) FILTER (n = 2) AS previous FROM r GROUP BY 1""",
    "failed_readings": """
        SELECT analysis_no FROM analyses a WHERE status = 'pending_review' AND NOT contains(lower(coalesce(error, '')), 'budget')
            AND NOT EXISTS (SELECT 1 FROM analyses b WHERE b.id = a.id AND b.status IN ('complete', 'irrelevant'))""",
}
