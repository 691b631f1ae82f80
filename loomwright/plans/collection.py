"""Queries over a collecting run: tasks, progress, health, caches, supplements and what a site shows of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import urls
from loomwright.functions.text import clean
from loomwright.operators import nested, quality, readings, search, series, tasks
from loomwright.operators import merge as merging
from loomwright.plans.flows import _C, _checks
from loomwright.plans.incremental import RULE_VERSION
from loomwright.plans.records import _INDEX, _STORED_SQL, _URL
from loomwright.session import instant, table
from loomwright.sources import files, html, store

COLUMNS = ["xznb_interpretations", "mhcn_interpretations", "qsfg_interpretations", "ldjy_notices"]
#: Organisations of the hosts in the tables, and of a host that serves two.
HOSTS = {"www.mhcn-energy.example": "茗河能源网", "www.xznb-energy.example": "溪州能源网", "www.qsfg-energy.example": "栖山能源网"}
TITLED = {"www.xznb-energy.example": ("储能", "溪州储能网")}
NEEDED = ["check_id", "id", "content_status", "close"]


def _p(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "policies")


def _failed():
    return F.coalesce(F.col("content_status"), F.lit("")) == "failed"


def task_batch(spark, d):
    """The first hundred tasks of the round-robin schedule."""
    rounds = tasks.interleaved(_p(spark, d), urls.host(F.col("url")), "record_id", F.floor(F.col("record_id") / 100_000))
    return tasks.batch(rounds, [F.asc("round"), F.asc("host_place"), F.asc("record_id")], 100).select("record_id", "round")


def whole_batch(spark, d):
    """A batch size of 0 takes every task."""
    return tasks.batch(_p(spark, d), [F.asc("record_id")], 0).select("record_id")


def backfill_open(spark, d):
    p = _p(spark, d)
    processed = table(spark, d, "policy_checks").where("content_status = 'complete'").select("id")
    broken = F.col("last_fetch_error").isNotNull() | (F.size("collection_issues") > 0)
    return tasks.backfill_open(p.select("record_id", "id"), p, processed, "id", broken).select("record_id")


def pending_left(spark, d):
    p = _p(spark, d)
    pending = p.select("id", F.explode("column_ids").alias("column_id")).distinct()
    done = _checks(spark, d).where("content_status = 'complete' AND status = 200").select("id")
    return tasks.left_pending(pending, done, "id", "column_id", table(spark, d, "column_health").where("status = 'ok'").select("column_id")).select("id", "column_id")


def column_progress(spark, d):
    stored = _p(spark, d).where(~_failed()).select("id", F.explode("column_ids").alias("column_id"))
    queue = _checks(spark, d).select("id", "column_id", (F.coalesce("content_status", F.lit("")) == "complete").alias("processed"), (~_failed()).alias("checked"))
    return tasks.progress(table(spark, d, "column_health"), stored, queue, "column_id", "id")


def health_update(spark, d):
    """Health after a run that made all checks with an attempt of 2 or more."""
    checks = _checks(spark, d).where("attempt >= 2 AND column_id IS NOT NULL")
    stats = checks.groupBy("column_id").agg((~F.bool_or(_failed())).alias("ok"), F.bool_or(F.coalesce("content_status", F.lit("")) == "partial").alias("pending"))
    return merging.health_after(stats, table(spark, d, "column_health"), "column_id", "run-1", "2026-07-20T00:00:00+00:00")


def supplement(spark, d):
    """The fifty newest entries of two columns, each address once."""
    p = _p(spark, d).select("record_id", "column_id", "url", "list_date")
    found = tasks.newest_supplement(p, "column_id", COLUMNS[:2], [F.desc_nulls_first("list_date"), F.asc("record_id")], "url")
    return found.select("record_id", "column_id", "url")


def probe_report(spark, d):
    """Attempts, good answers and the range of seconds of each source."""
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    return table(spark, d, "policy_checks").groupBy("source_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(ok).alias("good"), F.round(F.min("seconds"), 4).alias("fastest"), F.round(F.max("seconds"), 4).alias("slowest"))


def memberships(spark, d):
    """Each record's membership in its own column, as a list states it."""
    p = _p(spark, d)
    column = {"source_id": F.col("source_id"), "column_id": F.col("column_id"), "url": F.concat(F.lit("https://lists.example/"), F.coalesce("column_id", F.lit("")))}
    entry = {"list_date": F.col("list_date"), "list_date_raw": F.try_element_at("columns", F.lit(1))["list_date_raw"], "title": F.col("title")}
    return p.select("record_id", nested.membership(column, entry).alias("m")).select("record_id", "m.*")


def cache_kept(spark, d):
    """The reading a cache keeps of each id and input: a finished one is never replaced by one that is not."""
    a = table(spark, d, "analyses").where("input_hash IS NOT NULL AND relevance IS NOT NULL")
    done = F.col("status").isin("complete", "irrelevant")
    best = F.max_by("analysis_no", F.struct(done.alias("d"), F.coalesce(instant(F.col("analyzed_at")), F.lit("1970-01-01").cast("timestamp")).alias("t"), F.col("analysis_no").alias("n")))
    return a.groupBy("id", "input_hash").agg(best.alias("analysis_no"))


def cache_restored(spark, d):
    """Cached readings to put back: ids of 64 hexadecimal digits whose stored record has that input, and none finished by hand since."""
    stored = readings.stored_records(_p(spark, d))
    a = table(spark, d, "analyses")
    kept = cache_kept(spark, d).where(F.rlike("id", F.lit("^[0-9a-f]{64}$")))
    finished = a.where("status IN ('complete', 'irrelevant') AND review_status = '待核查'").select("id", "input_hash").distinct()
    current = readings.with_fingerprint(stored, RULE_VERSION).select("id", "input_hash")
    return kept.join(current, ["id", "input_hash"], "left_semi").join(finished, ["id", "input_hash"], "left_anti").select("id", "analysis_no")


def entries_stored(spark, d):
    """Rows of the store found through the canonical form of their address: (record_id, stored)."""
    p = _p(spark, d)
    ids = p.select(F.col("id").alias("page_id")).distinct().withColumn("stored", F.lit(True))
    keyed = p.select("record_id", urls.page_id(urls.normalize_url(F.col("url"))).alias("page_id"))
    return keyed.join(ids, "page_id", "left").select("record_id", F.coalesce("stored", F.lit(False)).alias("stored"))


def issuer_names(spark, d):
    return _p(spark, d).select("record_id", search.issuer_name(clean(F.col("issuer")), urls.host(F.col("url")), F.col("title"), HOSTS, TITLED).alias("issuer"))


def annotations(spark, d):
    items = _p(spark, d).where("publish_date IS NOT NULL").select("record_id", "column_id", "publish_date")
    return search.between_dates(items, "column_id", COLUMNS, "publish_date", "2022-01-01", "2025-12-31").select("record_id", "publish_date")


def dated_points(spark, d):
    return series.either(_p(spark, d), ["publish_date", "written_date"]).select("record_id")


def site_links(spark, d):
    return _p(spark, d).select("record_id", urls.link("/site/", F.concat(F.lit("/policies/"), F.col("id"), F.lit("/"))).alias("link"))


def entry_pages(spark, d):
    """One page for each record that is shown: its path and title."""
    shown = readings.reading_index(_p(spark, d), table(spark, d, "analyses"), table(spark, d, "analyses").where("status = 'complete' AND interpretation IS NOT NULL").select("id").distinct(), RULE_VERSION).where("visible")
    return shown.join(_p(spark, d).select("record_id", "title"), "record_id").select(F.concat(F.lit("policies/"), F.col("id")).alias("path"), "title")


def query_round_trip(spark, d):
    """Query strings written from a map and read back."""
    p = _p(spark, d)
    state = F.create_map(F.lit("q"), F.coalesce("title", F.lit("")), F.lit("source"), F.coalesce("source_id", F.lit("")), F.lit("page"), F.col("record_id").cast("string"))
    read = urls.query_parameters(F.concat(F.lit("https://site.example/?"), urls.query_string(state)))
    return p.select("record_id", read.alias("r")).select("record_id", F.coalesce(F.try_element_at("r", F.lit("q")), F.lit("")).alias("q"), F.try_element_at("r", F.lit("source")).alias("source"), F.try_element_at("r", F.lit("page")).alias("page"))


def spread_unit(spark, d):
    """Mean prices of the return flags of each ship mode as sharp, peak and valley, in hundredths."""
    line = table(spark, d, "lineitem")
    mean = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice")))
    # rounded to whole hundredths first, as such prices are published
    wide = line.groupBy("l_linestatus", "l_linenumber").agg(*[F.round(mean(f) * 100).alias(n) for f, n in (("R", "sharp"), ("N", "peak"), ("A", "valley"))])
    out = series.spreads(wide, F.col("sharp"), F.col("peak"), F.col("valley"), F.col("l_linenumber") % 2 == 0, 100, 2)
    return out.select("l_linestatus", F.col("l_linenumber").cast("long").alias("l_linenumber"), "peak_spread", "sharp_spread")


def date_axis(spark, d):
    days = table(spark, d, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return series.date_axis(days, "day", 132.0, 694.0, ["o_orderpriority"]).select("o_orderpriority", F.date_format("day", "yyyy-MM-dd").alias("day"), "x")


def manual_types(spark, d):
    """File types of attachments that no reader here can read."""
    known = F.array(*[F.lit(t) for t in sorted(html.FILE_TYPES)])
    return spark.range(1).select(F.explode(F.array_except(known, F.array(*[F.lit(t) for t in files.READABLE]))).alias("type"))


def required_columns(spark, d):
    """Which of the columns a step needs the log of checks has."""
    return quality.column_presence(table(spark, d, "policy_checks"), NEEDED)


def published_snapshot(spark, d):
    """Records published twice; readers find the second version."""
    from loomwright.session import scratch

    path, p = scratch(spark, "published"), _p(spark, d).select("record_id", "title")
    store.write_snapshot(p.where("record_id % 2 = 0"), path)
    store.write_snapshot(p.withColumn("title", clean(F.col("title"))), path)
    return store.read_snapshot(spark, path, "record_id bigint, title string")


def document_store(spark, d):
    """Records written one JSON document a file each (grouped by column) and read back under the explicit schema, a byte order mark before some."""
    from loomwright.schemas import DOCUMENTS
    from loomwright.session import scratch

    path = scratch(spark, "documents")
    p = _p(spark, d)
    body = F.concat(F.when(F.col("record_id") % 3 == 0, "﻿").otherwise(""), F.to_json(F.struct(*[c.name for c in spark.createDataFrame([], DOCUMENTS).schema], "record_id")))
    store.write_documents(p.select(F.concat(F.lit("r"), F.col("record_id").cast("string")).alias("stem"), body.alias("body")), path)
    read = store.read_documents(spark, path, f"{DOCUMENTS}, record_id bigint")
    return read.select("record_id", F.regexp_extract("_stem", "[0-9]+", 0).cast("long").alias("stem"), "id", "title", F.sha2(F.coalesce("content_text", F.lit("")), 256).alias("body"), F.size("columns").cast("long").alias("columns"))


def decoded_bodies(spark, d):
    """Bodies as bytes, every second one in GB18030, decoded again."""
    text = F.coalesce("title", F.lit(""))
    other = F.col("record_id") % 2 == 0
    raw = _p(spark, d).select("record_id", F.when(other, store.encoded(text, "gb18030")).otherwise(F.encode(text, "UTF-8")).alias("body"), F.when(F.col("record_id") % 4 == 0, "text/html; charset=gb18030").when(F.col("record_id") % 4 == 1, "charset=UTF-8").alias("type"))
    return raw.select("record_id", store.decoded(F.col("body"), F.col("type")).alias("title"))


QUERIES = {f.__name__: f for f in (
    task_batch, whole_batch, backfill_open, pending_left, column_progress, health_update, supplement, probe_report, memberships, cache_kept, cache_restored, entries_stored, issuer_names, annotations, dated_points,
    site_links, entry_pages, query_round_trip, spread_unit, date_axis, manual_types, required_columns, published_snapshot, document_store, decoded_bodies,
)}

_IN = "(" + ", ".join(f"'{c}'" for c in COLUMNS) + ")"
_HOST = "lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1), ''))"
_SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_CLEAN = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{_SP}+', ' ', 'g'))"
_KEPT = """
    kept AS (SELECT id, input_hash, analysis_no FROM analyses WHERE input_hash IS NOT NULL AND relevance IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, input_hash
        ORDER BY (coalesce(status, '') IN ('complete', 'irrelevant')) DESC, coalesce(try_cast(analyzed_at AS TIMESTAMPTZ), TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, analysis_no DESC) = 1)"""

SQL = {
    "task_batch": f"""
        WITH h AS (SELECT record_id, {_HOST} AS host FROM policies), r AS (SELECT record_id, row_number() OVER (PARTITION BY host ORDER BY record_id) AS round, min(record_id) OVER (PARTITION BY host) AS place FROM h)
        SELECT record_id, round FROM r ORDER BY round, place, record_id LIMIT 100""",
    "whole_batch": "SELECT record_id FROM policies",
    "backfill_open": """
        SELECT record_id FROM policies p WHERE NOT (EXISTS (SELECT 1 FROM policies q WHERE q.id = p.id AND q.last_fetch_error IS NULL AND NOT coalesce(len(q.collection_issues) > 0, false))
            AND EXISTS (SELECT 1 FROM policy_checks c WHERE c.id = p.id AND c.content_status = 'complete'))""",
    "pending_left": f"""
        WITH {_C}, t AS (SELECT DISTINCT id, unnest(column_ids) AS column_id FROM policies)
        SELECT id, column_id FROM t WHERE NOT (EXISTS (SELECT 1 FROM c WHERE c.id = t.id AND c.content_status = 'complete' AND c.status = 200)
            AND EXISTS (SELECT 1 FROM column_health h WHERE h.column_id = t.column_id AND h.status = 'ok'))""",
    "column_progress": f"""
        WITH {_C}, s AS (SELECT column_id, count(DISTINCT id) AS n FROM (SELECT id, unnest(column_ids) AS column_id FROM policies WHERE content_status IS DISTINCT FROM 'failed') GROUP BY 1),
        e AS (SELECT column_id, id, bool_or(coalesce(content_status, '') = 'complete') AS p, bool_or(coalesce(content_status, '') <> 'failed') AS k FROM c GROUP BY 1, 2),
        q AS (SELECT column_id, count(*) FILTER (NOT p) AS remaining, count(*) FILTER (NOT k) AS pending FROM e GROUP BY 1)
        SELECT h.column_id, coalesce(n, 0) AS stored_count, coalesce(remaining, 0) AS remaining, coalesce(pending, 0) AS pending
        FROM (SELECT DISTINCT column_id FROM column_health) h LEFT JOIN s USING (column_id) LEFT JOIN q USING (column_id)""",
    "health_update": f"""
        WITH {_C}, s AS (SELECT column_id, NOT bool_or(coalesce(content_status, '') = 'failed') AS ok, bool_or(coalesce(content_status, '') = 'partial') AS pending FROM c WHERE attempt >= 2 AND column_id IS NOT NULL GROUP BY 1)
        SELECT s.column_id, 'run-1' AS last_run_id, CASE WHEN ok AND NOT pending THEN '2026-07-20T00:00:00+00:00' ELSE h.last_success_at END AS last_success_at,
            CASE WHEN ok THEN 0 ELSE coalesce(h.consecutive_failures, 0) + 1 END::BIGINT AS consecutive_failures, CASE WHEN NOT ok THEN 'degraded' WHEN pending THEN 'pending' ELSE 'ok' END AS status
        FROM s LEFT JOIN column_health h USING (column_id)""",
    "supplement": f"""
        WITH n AS (SELECT record_id, column_id, url, row_number() OVER (PARTITION BY column_id ORDER BY list_date DESC NULLS FIRST, record_id) AS n FROM policies WHERE column_id IN ('{COLUMNS[0]}', '{COLUMNS[1]}') QUALIFY n <= 50)
        SELECT record_id, column_id, url FROM n QUALIFY row_number() OVER (PARTITION BY url ORDER BY n DESC, record_id DESC) = 1""",
    "probe_report": "SELECT source_id, count(*) AS attempts, count(*) FILTER (status = 200) AS good, round(min(seconds), 4) AS fastest, round(max(seconds), 4) AS slowest FROM policy_checks GROUP BY 1",
    "memberships": """
        SELECT record_id, source_id, column_id, 'https://lists.example/' || coalesce(column_id, '') AS list_url, list_date, columns[1].list_date_raw AS list_date_raw, title AS list_title FROM policies""",
    "cache_kept": f"WITH {_KEPT} SELECT id, input_hash, analysis_no FROM kept",
    "cache_restored": f"""
        WITH {_STORED_SQL}, {_KEPT} SELECT id, analysis_no FROM kept k WHERE regexp_full_match(id, '[0-9a-f]{{64}}') AND EXISTS (SELECT 1 FROM stored s WHERE s.id = k.id AND s.input_hash = k.input_hash)
            AND NOT EXISTS (SELECT 1 FROM analyses a WHERE a.id = k.id AND a.input_hash = k.input_hash AND a.status IN ('complete', 'irrelevant') AND a.review_status = '待核查')""",
    "entries_stored": f"""
        WITH u AS ({_URL}) SELECT record_id, page_id IN (SELECT id FROM policies) AS stored FROM u""",
    "issuer_names": f"""
        SELECT record_id, coalesce(nullif({_CLEAN('issuer')}, ''), CASE WHEN {_HOST} = 'www.xznb-energy.example' AND contains(coalesce(title, ''), '储能') THEN '溪州储能网'
            {" ".join(f"WHEN {_HOST} = '{h}' THEN '{n}'" for h, n in HOSTS.items())} ELSE '未提供' END) AS issuer FROM policies""",
    "annotations": f"SELECT record_id, publish_date FROM policies WHERE column_id IN {_IN} AND publish_date BETWEEN '2022-01-01' AND '2025-12-31'",
    "dated_points": "SELECT record_id FROM policies WHERE publish_date IS NOT NULL OR written_date IS NOT NULL",
    "site_links": "SELECT record_id, '/site/policies/' || id || '/' AS link FROM policies",
    "entry_pages": f"WITH {_INDEX} SELECT 'policies/' || i.id AS path, p.title FROM i JOIN policies p USING (record_id) WHERE visible",
    "query_round_trip": "SELECT record_id, coalesce(title, '') AS q, nullif(coalesce(source_id, ''), '') AS source, record_id::VARCHAR AS page FROM policies",
    "spread_unit": """
        WITH w AS (SELECT l_linestatus, l_linenumber, round(avg(l_extendedprice) FILTER (l_returnflag = 'R') * 100) AS sharp, round(avg(l_extendedprice) FILTER (l_returnflag = 'N') * 100) AS peak,
                round(avg(l_extendedprice) FILTER (l_returnflag = 'A') * 100) AS valley FROM lineitem GROUP BY ALL)
        SELECT l_linestatus, l_linenumber::BIGINT AS l_linenumber, round((peak - valley) / 100, 2) AS peak_spread, CASE WHEN l_linenumber % 2 = 0 THEN round((sharp - valley) / 100, 2) END AS sharp_spread FROM w""",
    "date_axis": """
        WITH s AS (SELECT DISTINCT o_orderpriority, o_orderdate::DATE AS day FROM orders), b AS (SELECT *, min(day) OVER w AS a, max(day) OVER w AS z FROM s WINDOW w AS (PARTITION BY o_orderpriority))
        SELECT o_orderpriority, strftime(day, '%Y-%m-%d') AS day, round(132 + (day - a) / greatest(1, z - a) * 694, 2) AS x FROM b""",
    "manual_types": "SELECT unnest([" + ", ".join(f"'{t}'" for t in sorted(html.FILE_TYPES)) + "]) AS type EXCEPT SELECT unnest(['pdf', 'docx', 'xlsx'])",
    "required_columns": "SELECT n AS name, n IN (SELECT column_name FROM (DESCRIBE policy_checks)) AS present FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in NEEDED) + "]) AS n)",
    "published_snapshot": f"SELECT record_id, {_CLEAN('title')} AS title FROM policies",
    "document_store": "SELECT record_id, record_id AS stem, id, title, sha256(coalesce(content_text, '')) AS body, coalesce(len(columns), -1) AS columns FROM policies",
    "decoded_bodies": "SELECT record_id, coalesce(title, '') AS title FROM policies",
}
