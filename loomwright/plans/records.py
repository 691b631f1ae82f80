"""Queries over stored records: text functions, groups, screening, search and integrity."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions import urls
from loomwright.operators import dedup, merge, quality, readings, screen, search
from loomwright.plans.incremental import RULE_VERSION
from loomwright.session import table

# Whom a policy may concern.
TARGETS = ["工商业用户侧储能", "独立储能", "电源侧配储", "电网侧储能", "储能产业链"]
SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"  # white space for DuckDB, as functions.text.SPACE


def _p(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "policies")


def _a(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "analyses")


def _completed(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).where((F.col("status") == "complete") & F.col("interpretation").isNotNull()).select("id").distinct()


def _source(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, id, input_hash, source, content_status, attachments): title, body and attachment texts of every row, and the fingerprint of what was read."""
    p = _p(spark, d)
    attached = F.array_join(F.transform(F.filter(F.coalesce("attachments", F.array().cast(p.schema["attachments"].dataType)), lambda a: F.coalesce(a["text"], F.lit("")) != ""), lambda a: F.concat(F.lit("\n附件："), F.coalesce(a["name"], F.lit("")), F.lit("\n"), a["text"])), "")
    source = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content_text", F.lit("")), attached)
    return p.select("record_id", "id", T.fingerprint(RULE_VERSION, F.col("title"), F.col("content_hash"), F.col("attachments_hash")).alias("input_hash"), source.alias("source"), "content_status", "attachments")


def _seen(spark: SparkSession, d: str) -> DataFrame:
    """Readings with an interpretation and the ``source`` they were made from; null where no stored row has that input.

    Rows of one id and input hold the same title and hashes; the smallest record_id stands for them.
    """
    rows = _source(spark, d)
    one = rows.groupBy("id", "input_hash").agg(F.min("record_id").alias("record_id")).join(rows.select("record_id", "source"), "record_id")
    return _a(spark, d).where("interpretation IS NOT NULL").join(one, ["id", "input_hash"], "left")


def _index(spark: SparkSession, d: str) -> DataFrame:
    return readings.reading_index(_p(spark, d), _a(spark, d), _completed(spark, d), RULE_VERSION)


def text_clean(spark, d):
    return _p(spark, d).select("record_id", T.clean(F.col("title")).alias("title"), F.length(F.coalesce(T.compact(F.col("content_text")), F.lit(""))).cast("long").alias("chars"))


def date_extract(spark, d):
    raw = F.coalesce(F.try_element_at("columns", F.lit(1))["list_date_raw"], F.lit(""))
    return _p(spark, d).select("record_id", T.iso_date(raw).alias("listed"), T.iso_date(F.col("publish_date")).alias("published"), T.iso_date(F.col("title")).alias("titled"))


def title_parts(spark, d):
    title = F.col("title")
    return _p(spark, d).select(
        "record_id", T.document_number(title).alias("known_number"), T.title_issuer(title).alias("known_issuer"), T.document_number(title, T.ANY_NUMBER).alias("number"), T.title_issuer(title, T.ANY_ISSUER).alias("issuer"),
        T.standalone_number(F.col("content_text")).alias("header_number"),
    )


def url_normalize(spark, d):
    normal = urls.normalize_url(F.col("url"))
    return _p(spark, d).select("record_id", normal.alias("url")).select("record_id", "url", urls.page_id(F.col("url")).alias("page_id"))


def url_parts(spark, d):
    return _p(spark, d).select("record_id", urls.host(F.col("url")).alias("host"), T.extension(F.col("url")).alias("extension"), urls.safe_url(F.col("url")).alias("safe"))


def hash_mismatch(spark, d):
    return _p(spark, d).select("record_id", (F.col("content_hash") == F.sha2(F.coalesce("content_text", F.lit("")), 256)).alias("body"), (F.col("attachments_hash") == merge.attachment_digest(F.col("attachments"))).alias("files"))


def fingerprint_stale(spark, d):
    seen = _p(spark, d).select("id", T.fingerprint(RULE_VERSION, F.col("title"), F.col("content_hash"), F.col("attachments_hash")).alias("input_hash")).distinct().withColumn("current", F.lit(True))
    return _a(spark, d).select("analysis_no", "id", "input_hash").join(seen, ["id", "input_hash"], "left").select("analysis_no", F.coalesce("current", F.lit(False)).alias("current"))


def keyword_screen(spark, d):
    hits = screen.screened(_p(spark, d), F.col("title"), F.col("content_text"))
    return hits.where(F.size("keywords") > 0).select("record_id", F.array_join("keywords", "|").alias("keywords"))


def reading_index(spark, d):
    return _index(spark, d).select("id", "record_id", "canonical_id", F.array_join("keywords", "|").alias("keywords"), "relevance", "status", "visible")


def topic_counts(spark, d):
    return readings.topic_counts(_index(spark, d))


def category_counts(spark, d):
    return readings.category_counts(_index(spark, d))


def index_summary(spark, d):
    return readings.index_summary(_index(spark, d))


def topic_shares(spark, d):
    return readings.topic_shares(_index(spark, d))


def relevance_texts(spark, d):
    text = T.relevance_text(F.col("title"), F.col("content_text"), F.transform("attachments", lambda a: a["text"]))
    return _p(spark, d).select("record_id", F.length(text).cast("long").alias("chars"), F.sha2(text, 256).alias("digest"))


def whitelisted_readings(spark, d):
    """The six validated fields of an interpretation, and nothing else of it."""
    x = lambda f: F.col(f"interpretation.{f}")
    lists = [F.array_join(x(f), "|").alias(f) for f in ("key_points", "topics", "targets", "evidence")]
    return _a(spark, d).where("interpretation IS NOT NULL").select("analysis_no", x("summary").alias("summary"), *lists, x("impact.direction").alias("direction"), x("impact.reason").alias("reason"))


def group_members(spark, d):
    """Members of the groups of several records, each joined with its stored record; a member without one is an error."""
    p = _p(spark, d)
    members = dedup.canonical(p, _completed(spark, d)).where("members > 1").select("canonical_id", "record_id")
    return quality.referential(members, p.select("record_id", "id", "url"), "record_id", "missing record").select("canonical_id", "record_id", "id", "url")


def dedup_canonical(spark, d):
    return dedup.canonical(_p(spark, d), _completed(spark, d)).select("record_id", "canonical_record", "members")


def dedup_canonical_nfkc(spark, d):
    p = _p(spark, d).withColumn("_form", T.normalized_title(F.col("title")))
    return dedup.canonical(p, _completed(spark, d), F.col("_form")).select("record_id", "canonical_record", "members")


def dedup_groups(spark, d):
    found = dedup.groups(_p(spark, d), _completed(spark, d)).where(F.size("member_ids") > 1)
    return found.select("canonical_id", F.array_join("member_ids", "|").alias("member_ids"), F.array_join(F.transform("source_links", lambda x: F.coalesce(x["url"], F.lit(""))), "|").alias("urls"))


def dedup_summary(spark, d):
    return dedup.summary(_p(spark, d), _completed(spark, d))


def duplicate_keys(spark, d):
    p = _p(spark, d)
    return quality.duplicate_violations(p, "id", ["id"], F.col("id")).unionByName(quality.duplicate_violations(p.where("url IS NOT NULL"), "url", ["url"], F.col("url")))


def integrity_counts(spark, d):
    p = _p(spark, d)
    columns = p.select(F.lit("column").alias("kind"), F.explode(F.coalesce("column_ids", F.array().cast("array<string>"))).alias("value"))
    status = p.select(F.lit("content").alias("kind"), F.coalesce("content_status", F.lit("")).alias("value"))
    attached = p.select(F.lit("attachment").alias("kind"), F.explode(F.transform("attachments", lambda a: F.coalesce(a["status"], F.lit("")))).alias("value"))
    several = p.where(F.size("columns") > 1).select(F.lit("several").alias("kind"), F.lit("").alias("value"))
    return columns.unionByName(status).unionByName(attached).unionByName(several).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


EVIDENCED = ("publish_date", "written_date", "issuer", "doc_number")
# Words of navigation that a body should not hold.
NAVIGATION = ("设为首页", "网站地图", "扫一扫在手机打开当前页", "目录项的基本信息", "ICP备")


def quality_violations(spark, d):
    text = F.coalesce("content_text", F.lit(""))
    rules = {
        "bad_id": ~F.rlike("id", F.lit("^[0-9a-f]{64}$")),
        "other_id": F.col("id") != urls.page_id(urls.normalize_url(F.col("url"))),
        "body_hash": F.col("content_hash") != F.sha2(text, 256),
        "attachment_hash": F.col("attachments_hash") != merge.attachment_digest(F.col("attachments")),
        "image_with_text": (F.col("content_status") == "image_only") & (F.length(text) >= 40),
        "empty_complete": (F.col("content_status") == "complete") & (F.length(text) == 0),
        "no_title": T.clean(F.col("title")) == "",
        "repeated_column": F.size(F.array_distinct(F.transform("columns", lambda c: c["column_id"]))) < F.size("columns"),
        "open_issue": (F.size("collection_issues") > 0) | F.col("last_fetch_error").isNotNull(),
    }
    for field in ("list_date", "publish_date", "written_date"):
        rules[f"bad_{field}"] = (F.col(field) != "") & F.try_to_timestamp(F.col(field), F.lit("yyyy-MM-dd")).isNull()
    for field in EVIDENCED:
        rules[f"no_evidence_{field}"] = (F.col(field) != "") & F.try_element_at("field_evidence", F.lit(field)).isNull()
    for word in NAVIGATION:
        rules[f"navigation_{word}"] = F.contains(text, F.lit(word))
    return quality.violations(_p(spark, d), "record_id", rules)


def evidence_contains(spark, d):
    rows = _seen(spark, d)
    return rows.select("analysis_no", F.when(F.col("source").isNotNull(), F.coalesce(T.quotes_grounded(F.col("interpretation.evidence"), F.col("source")), F.lit(False))).alias("grounded"))


def numbers_ungrounded(spark, d):
    rows = _seen(spark, d)
    output = F.concat(F.coalesce("interpretation.summary", F.lit("")), F.coalesce(F.array_join("interpretation.key_points", ""), F.lit("")))
    return rows.select("analysis_no", F.array_join(T.ungrounded_numbers(output, F.col("source")), "|").alias("numbers"))


def interpretation_checks(spark, d):
    rows = _seen(spark, d)
    return rows.select("analysis_no", F.when(F.col("source").isNull(), "source").otherwise(quality.interpretation_failure(F.col("interpretation"), F.col("source"), screen.TOPICS, TARGETS)).alias("failure"))


def text_truncate(spark, d, limit: int = 1500):
    s = _source(spark, d)
    cut = F.length("source") > limit
    reasons = F.array_compact(F.array(F.when(~F.coalesce(F.col("content_status") == "complete", F.lit(False)), F.lit("body")), F.when(F.coalesce(F.exists("attachments", lambda a: F.coalesce(a["status"], F.lit("")) != "parsed"), F.lit(False)), F.lit("attachments")), F.when(cut, F.lit("length"))))
    return s.select("record_id", F.length(T.shortened(F.col("source"), limit)).cast("long").alias("chars"), F.sha2(T.shortened(F.col("source"), limit), 256).alias("digest"), F.array_join(reasons, "|").alias("reasons"))


def byte_guard(spark, d):
    return _source(spark, d).where(~T.bytes_within(F.col("source"), 5000)).select("record_id", F.octet_length("source").cast("long").alias("bytes"))


def attachment_digests(spark, d):
    """The digests are those stored with the records."""
    return _p(spark, d).select("record_id", merge.attachment_digest(F.col("attachments")).alias("digest"), F.array_join(merge.binary_keys(F.col("attachments")), "|").alias("keys"))


def coverage_missing(spark, d):
    """(column_id, discovered, missing): of the ids the checks found in a column, those without a complete record."""
    found = table(spark, d, "policy_checks").select("column_id", "id").distinct()
    missing = quality.missing_from(found, _p(spark, d).where("content_status = 'complete'"), "id").groupBy("column_id").agg(F.count(F.lit(1)).alias("missing"))
    counts = found.groupBy("column_id").agg(F.count(F.lit(1)).alias("discovered"))
    return counts.join(missing, counts["column_id"].eqNullSafe(missing["column_id"]), "left").select(counts["column_id"], "discovered", F.coalesce("missing", F.lit(0)).cast("long").alias("missing"))


def semi_analysed(spark, d):
    return _p(spark, d).join(_completed(spark, d), "id", "left_semi").select("record_id")


def column_membership(spark, d):
    listed = _p(spark, d).select("record_id", F.explode(F.array_distinct("column_ids")).alias("column_id"))
    return listed.join(table(spark, d, "column_health").select("column_id", "name", F.col("status").alias("health")), "column_id").groupBy("column_id", "name", "health").agg(F.count(F.lit(1)).alias("records"))


def id_columns(spark, d):
    both = merge.union_of_arrays(_p(spark, d), "id", "column_ids")
    return both.select("id", F.array_join("column_ids", "|").alias("column_ids"))


def display_dates(spark, d):
    return _p(spark, d).select("record_id", search.display_date(F.col("publish_date"), F.col("list_date")).alias("date"), F.coalesce(F.nullif(T.clean(F.col("issuer")), F.lit("")), urls.host(F.col("url"))).alias("issuer"))


def _items(spark, d):
    return _p(spark, d).select(
        "record_id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content_text", F.lit(""))).alias("text"), "column_ids", F.coalesce("source_id", F.lit("")).alias("source_id"), search.display_date(F.col("publish_date"), F.col("list_date")).alias("date")
    )


FACETS = search.Facets("储能 bms", scalars=(), since="2022-01-01", until="2026-12-31")


def search_facets(spark, d):
    return search.matching(_items(spark, d), FACETS).select("record_id", "date")


def search_array_facet(spark, d):
    return search.matching(_items(spark, d), search.Facets("容量", arrays=(("column_ids", "xznb_interpretations"),), scalars=(("source_id", "xznb"),))).select("record_id")


def search_page(spark, d):
    found = search.matching(_items(spark, d), search.Facets("容量"))
    return search.page(found, [F.desc("date"), F.asc("record_id")], 2).select("record_id", "date")


def recent_30d(spark, d):
    return search.recent(_items(spark, d), "date", "2026-03-31").select("record_id", "date")


def facet_issuers(spark, d):
    return search.facet_values(_p(spark, d), T.clean(F.col("issuer")))


def related_top5(spark, d):
    items = _a(spark, d).where("interpretation IS NOT NULL").select("analysis_no", F.col("interpretation.topics").alias("topics"))
    return search.related(items, "analysis_no", "topics", [F.col("analysis_no")]).select("analysis_no", "other", F.col("n").cast("long").alias("n"))


def set_operations(spark, d):
    p, c = _p(spark, d).select("id").distinct(), table(spark, d, "policy_checks").select("id").distinct()
    kinds = {"union": p.union(c).distinct(), "both": p.intersect(c), "only_stored": p.exceptAll(c), "only_checked": c.exceptAll(p)}
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in kinds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def seeded_sample(spark, d, seed: str = "11", most: int = 10):
    return _p(spark, d).select("record_id", F.md5(F.concat_ws(":", F.col("record_id").cast("string"), F.lit(seed))).alias("draw")).orderBy("draw", "record_id").limit(most)


def _json_items(name):
    return f"coalesce(to_json({name})::VARCHAR, 'null')"


_HASH = f"""sha256('["{RULE_VERSION}", ' || {_json_items('title')} || ', ' || {_json_items('content_hash')} || ', ' || {_json_items('attachments_hash')} || ']')"""
_SOURCE = f"""
    src AS (SELECT id, record_id, {_HASH} AS input_hash, coalesce(title, '') || chr(10) || coalesce(content_text, '')
              || coalesce(array_to_string(list_transform(list_filter(attachments, lambda a: coalesce(a.text, '') <> ''),
                   lambda a: chr(10) || '附件：' || coalesce(a.name, '') || chr(10) || a.text), ''), '') AS source, content_status, attachments
            FROM policies),
    one AS (SELECT id, input_hash, source FROM src QUALIFY row_number() OVER (PARTITION BY id, input_hash ORDER BY record_id) = 1)"""
_DISPLAY = "coalesce(nullif(publish_date, ''), nullif(list_date, ''), '')"
_KEYS = "[" + ", ".join(f"'{k}'" for k in screen.KEYWORDS) + "]"
_TOPICS = "[" + ", ".join(f"'{k}'" for k in screen.TOPICS) + "]"
_TARGETS = "[" + ", ".join(f"'{k}'" for k in TARGETS) + "]"
_DATE = r"(20[0-9]{2})[-年/.]([0-9]{1,2})[-月/.]([0-9]{1,2})日?"
_BARE = r"regexp_replace(coalesce(title, ''), '[\s\x0b\x1c-\x1f\x{85}\p{Z}\x{200b}\x{feff}]+', '', 'g')"
_TITLE = f"translate({_BARE}, '“”‘’', chr(34) || chr(34) || chr(39) || chr(39))"


def _iso(x):
    g = lambda i: f"regexp_extract({x}, '{_DATE}', {i})"
    return f"strftime(try_strptime({g(1)} || '-' || lpad({g(2)}, 2, '0') || '-' || lpad({g(3)}, 2, '0'), '%Y-%m-%d'), '%Y-%m-%d')"


_GROUPED = f"""
    done AS (SELECT DISTINCT id FROM analyses WHERE status = 'complete' AND interpretation IS NOT NULL),
    g AS (SELECT p.record_id, p.id, p.url,
            CASE WHEN publish_date <> '' THEN {_TITLE} || chr(1) || publish_date ELSE 'own' || record_id END AS k,
            (CASE WHEN done.id IS NULL THEN 1 ELSE 0 END) AS o1, (CASE WHEN content_status = 'complete' THEN 0 ELSE 1 END) AS o2,
            length(regexp_replace(coalesce(content_text, ''), '{SP}+', '', 'g')) AS chars
          FROM policies p LEFT JOIN done ON done.id = p.id)"""
_ORDER = "ORDER BY o1, o2, chars DESC, id, record_id"


def _nfkc(name: str) -> str:
    """NFKC in SQL for the blocks of compatibility characters that titles use: those made plain by rule, then NFC."""
    blocks = ((0xA0, 0xBF), (0x2000, 0x206F), (0x2100, 0x218F), (0x2460, 0x24FF), (0x2F00, 0x2FDF), (0x3000, 0x303F), (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF00, 0xFFEF))
    plain = {chr(c): unicodedata.normalize("NFKC", chr(c)) for low, high in blocks for c in range(low, high + 1)}
    changed = {c: to for c, to in plain.items() if c != to}
    quoted = lambda x: x.replace("'", "''")
    single = {c: to for c, to in changed.items() if len(to) == 1}
    sql = f"translate({name}, '{quoted(''.join(single))}', '{quoted(''.join(single.values()))}')"
    for c, to in changed.items():
        if len(to) > 1:
            sql = f"replace({sql}, '{c}', '{quoted(to)}')"
    return f"nfc_normalize({sql})"


_URL = r"""
        SELECT record_id, u AS url, sha256(u) AS page_id FROM (SELECT record_id, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS u FROM (SELECT record_id, url,
            array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))), '&') AS q FROM policies))"""
_STORED_SQL = f"stored AS (SELECT *, {_HASH} AS input_hash FROM policies QUALIFY row_number() OVER (PARTITION BY id ORDER BY (content_status IS DISTINCT FROM 'failed') DESC, try_cast(last_checked_at AS TIMESTAMPTZ) DESC NULLS LAST, record_id) = 1)"
_STORED = _GROUPED.replace("FROM policies p", "FROM stored p")
_INDEX = f"""
    {_STORED_SQL},
    {_STORED},
    c AS (SELECT record_id, first_value(id) OVER (PARTITION BY k {_ORDER}) AS canonical_id FROM g),
    r AS (SELECT a.id, a.relevance, a.status, a.review_status, a.interpretation FROM analyses a JOIN stored s ON s.id = a.id AND s.input_hash = a.input_hash
          QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY CASE a.status WHEN 'complete' THEN 0 WHEN 'irrelevant' THEN 1 WHEN 'pending_review' THEN 2 WHEN 'pending' THEN 3 ELSE 4 END,
              try_cast(a.analyzed_at AS TIMESTAMPTZ) DESC NULLS LAST, a.analysis_no) = 1),
    x AS (SELECT s.id, s.record_id, c.canonical_id, list_filter({_KEYS}, lambda k: contains(coalesce(title, '') || chr(10) || coalesce(content_text, ''), k)) AS keys,
              r.id IS NOT NULL AS current, r.relevance, r.status AS reading, r.review_status, r.interpretation.topics AS topics
          FROM stored s JOIN c USING (record_id) LEFT JOIN r ON r.id = s.id),
    i AS (SELECT *, CASE WHEN len(keys) = 0 THEN 'keyword_no_match' WHEN current THEN coalesce(reading, 'pending') ELSE 'pending' END AS status,
              len(keys) > 0 AND current AND coalesce(reading = 'complete' AND relevance IN ('直接相关', '间接相关'), false) AS visible FROM x)"""

QUERIES = {f.__name__: f for f in (
    reading_index, index_summary, topic_shares, relevance_texts, whitelisted_readings, group_members,
    text_clean, date_extract, title_parts, url_normalize, url_parts, hash_mismatch, fingerprint_stale, keyword_screen, topic_counts, category_counts, dedup_canonical, dedup_canonical_nfkc, dedup_groups,
    dedup_summary, duplicate_keys, integrity_counts, quality_violations, evidence_contains, numbers_ungrounded, interpretation_checks, text_truncate, byte_guard, attachment_digests, coverage_missing,
    semi_analysed, column_membership, id_columns, display_dates, search_facets, search_array_facet, search_page, recent_30d, facet_issuers, related_top5, set_operations, seeded_sample,
)}

SQL = {
    "text_clean": rf"SELECT record_id, trim(regexp_replace(coalesce(title, ''), '{SP}+', ' ', 'g')) AS title, length(regexp_replace(coalesce(content_text, ''), '{SP}+', '', 'g')) AS chars FROM policies",
    "date_extract": f"SELECT record_id, {_iso('coalesce(columns[1].list_date_raw, chr(32))')} AS listed, {_iso('publish_date')} AS published, {_iso('title')} AS titled FROM policies",
    "title_parts": rf"""
        SELECT record_id, nullif(trim(regexp_replace(regexp_extract(title, '国家能源局公告[\s\p{{Z}}]*20[0-9]{{2}}年第[0-9]+号'), '{SP}+', ' ', 'g')), '') AS known_number,
            nullif(regexp_extract(title, '^({"|".join(T.ISSUERS)})[\s\p{{Z}}]*(?:{"|".join(T.AFTER_ISSUER)})', 1), '') AS known_issuer,
            nullif(trim(regexp_replace(regexp_extract(title, '[\x{{4e00}}-\x{{9fff}}A-Za-z]{{1,20}}[〔\[［(（]20[0-9]{{2}}[〕\]］)）]\s*[0-9]+号'), '{SP}+', ' ', 'g')), '') AS number,
            nullif(regexp_extract(title, '^([^，。；：:《》]{{2,65}}?(?:局|厅|委员会|委|部|办公室|分行|人民政府|司|中心))[\s\p{{Z}}]*(?:{"|".join(T.AFTER_ISSUER)})', 1), '') AS issuer,
            list_filter(string_split(content_text, chr(10))[1:15], lambda l: regexp_full_match(l, '[\x{{4e00}}-\x{{9fff}}A-Za-z]{{1,20}}[〔\[［(]20[0-9]{{2}}[〕\]］)]\s*[0-9]+号'))[1] AS header_number
        FROM policies""",
    "url_parts": """
        SELECT record_id, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1), '')) AS host,
            nullif(lower(regexp_extract(url, '\\.([^./?#]+)(?:[?#].*)?$', 1)), '') AS extension,
            CASE WHEN regexp_matches(url, '^(?i:https?):') THEN url END AS safe FROM policies""",
    "url_normalize": _URL,
    "hash_mismatch": "SELECT record_id, content_hash = sha256(coalesce(content_text, '')) AS body, CASE WHEN attachments_hash IS NOT NULL THEN true END AS files FROM policies",
    "fingerprint_stale": f"""
        WITH h AS (SELECT DISTINCT id, sha256('["{RULE_VERSION}", ' || {_json_items('title')} || ', ' || {_json_items('content_hash')} || ', ' || {_json_items('attachments_hash')} || ']') AS h FROM policies)
        SELECT analysis_no, EXISTS (SELECT 1 FROM h WHERE h.id = a.id AND h.h = a.input_hash) AS current FROM analyses a""",
    "keyword_screen": f"""
        SELECT record_id, array_to_string(k, '|') AS keywords FROM (
            SELECT record_id, list_filter({_KEYS}, lambda k: contains(coalesce(title, '') || chr(10) || coalesce(content_text, ''), k)) AS k FROM policies) WHERE len(k) > 0""",
    "topic_counts": f"""
        WITH {_INDEX}, t AS (SELECT unnest({_TOPICS}) AS topic), n AS (SELECT unnest(topics) AS topic FROM i WHERE id = canonical_id AND len(keys) > 0 AND status = 'complete')
        SELECT t.topic, count(n.topic) AS n FROM t LEFT JOIN n USING (topic) GROUP BY t.topic""",
    "topic_shares": f"""
        WITH {_INDEX}, t AS (SELECT unnest({_TOPICS}) AS topic), n AS (SELECT unnest(topics) AS topic FROM i WHERE visible AND id = canonical_id),
        k AS (SELECT t.topic, count(n.topic) AS n FROM t LEFT JOIN n USING (topic) GROUP BY t.topic)
        SELECT topic, n, round(n / greatest(1, max(n) OVER ()), 6) AS share FROM k""",
    "reading_index": f"WITH {_INDEX} SELECT id, record_id, canonical_id, array_to_string(keys, '|') AS keywords, relevance, status, visible FROM i",
    "index_summary": f"""
        WITH {_INDEX} SELECT count(*) FILTER (id = canonical_id) AS total, count(*) AS raw_total, count(*) - count(*) FILTER (id = canonical_id) AS merged_records,
            count(*) FILTER (id = canonical_id AND len(keys) > 0) AS keyword_matches FROM i""",
    "relevance_texts": """
        WITH t AS (SELECT record_id, coalesce(title, '') || chr(10) || '正文：' || chr(10) || coalesce(content_text, '')[1:2000] || chr(10) || '附件解析文本：' || chr(10)
              || coalesce(array_to_string(list_filter(list_transform(attachments, lambda a: a.text), lambda x: coalesce(x, '') <> ''), chr(10)), '')[1:2000] AS t FROM policies)
        SELECT record_id, length(t) AS chars, sha256(t) AS digest FROM t""",
    "whitelisted_readings": """
        SELECT analysis_no, interpretation.summary AS summary, array_to_string(interpretation.key_points, '|') AS key_points, array_to_string(interpretation.topics, '|') AS topics,
            array_to_string(interpretation.targets, '|') AS targets, array_to_string(interpretation.evidence, '|') AS evidence, interpretation.impact.direction AS direction, interpretation.impact.reason AS reason
        FROM analyses WHERE interpretation IS NOT NULL""",
    "group_members": f"""
        WITH {_GROUPED}, m AS (SELECT record_id, first_value(id) OVER (PARTITION BY k {_ORDER}) AS canonical_id, count(*) OVER (PARTITION BY k) AS members FROM g)
        SELECT canonical_id, record_id, p.id, p.url FROM m JOIN policies p USING (record_id) WHERE members > 1""",
    "category_counts": f"""
        WITH {_INDEX}, h AS (SELECT * FROM i WHERE id = canonical_id AND len(keys) > 0)
        SELECT count(*) FILTER (relevance = '直接相关') AS direct, count(*) FILTER (relevance = '间接相关') AS indirect, count(*) FILTER (relevance = '无关') AS unrelated,
            count(*) FILTER (relevance IS NULL OR relevance NOT IN ('直接相关', '间接相关', '无关')) AS undecided, count(*) FILTER (review_status = '待核查') AS to_check FROM h""",
    "dedup_canonical": f"WITH {_GROUPED} SELECT record_id, first_value(record_id) OVER (PARTITION BY k {_ORDER}) AS canonical_record, count(*) OVER (PARTITION BY k) AS members FROM g",
    "dedup_canonical_nfkc": f"""
        WITH {_GROUPED.replace("coalesce(title, '')", f"coalesce({_nfkc('title')}, '')")} SELECT record_id, first_value(record_id) OVER (PARTITION BY k {_ORDER}) AS canonical_record, count(*) OVER (PARTITION BY k) AS members FROM g""",
    "dedup_groups": f"""
        WITH {_GROUPED} SELECT first(id {_ORDER}) AS canonical_id, string_agg(id, '|' {_ORDER}) AS member_ids, string_agg(coalesce(url, ''), '|' {_ORDER}) AS urls FROM g GROUP BY k HAVING count(*) > 1""",
    "dedup_summary": f"WITH {_GROUPED} SELECT count(DISTINCT k) AS groups, count(*) AS records, count(*) - count(DISTINCT k) AS merged FROM g",
    "duplicate_keys": """
        SELECT 'id' AS rule, id AS value FROM policies GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'url', url FROM policies WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1""",
    "integrity_counts": """
        SELECT kind, value, count(*) AS n FROM (
            SELECT 'column' AS kind, unnest(column_ids) AS value FROM policies
            UNION ALL SELECT 'content', coalesce(content_status, '') FROM policies
            UNION ALL SELECT 'attachment', coalesce(unnest(attachments).status, '') FROM policies
            UNION ALL SELECT 'several', '' FROM policies WHERE len(columns) > 1) GROUP BY ALL""",
    "quality_violations": rf"""
        SELECT 'bad_id' AS rule, record_id FROM policies WHERE NOT regexp_full_match(id, '[0-9a-f]{{64}}')
        UNION ALL SELECT 'other_id', record_id FROM policies JOIN ({_URL}) USING (record_id) WHERE id <> page_id
        UNION ALL SELECT 'body_hash', record_id FROM policies WHERE content_hash <> sha256(coalesce(content_text, ''))
        UNION ALL SELECT 'image_with_text', record_id FROM policies WHERE content_status = 'image_only' AND length(content_text) >= 40
        UNION ALL SELECT 'empty_complete', record_id FROM policies WHERE content_status = 'complete' AND coalesce(content_text, '') = ''
        UNION ALL SELECT 'no_title', record_id FROM policies WHERE trim(regexp_replace(coalesce(title, ''), '{SP}+', ' ', 'g')) = ''
        UNION ALL SELECT 'repeated_column', record_id FROM policies WHERE len(list_distinct(list_transform(columns, lambda c: c.column_id))) < len(columns)
        UNION ALL SELECT 'open_issue', record_id FROM policies WHERE len(collection_issues) > 0 OR last_fetch_error IS NOT NULL""" + "".join(
        f" UNION ALL SELECT 'bad_{f}', record_id FROM policies WHERE {f} <> '' AND (NOT regexp_full_match({f}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR try_strptime({f}, '%Y-%m-%d') IS NULL)" for f in ("list_date", "publish_date", "written_date")
    ) + "".join(f" UNION ALL SELECT 'no_evidence_{f}', record_id FROM policies WHERE {f} <> '' AND field_evidence['{f}'] IS NULL" for f in EVIDENCED)
    + "".join(f" UNION ALL SELECT 'navigation_{w}', record_id FROM policies WHERE contains(content_text, '{w}')" for w in NAVIGATION),
    "evidence_contains": rf"""
        WITH {_SOURCE}, e AS (SELECT analysis_no, coalesce(len(list_filter(interpretation.evidence, lambda q: NOT (length(q) >= 8 AND
            contains(regexp_replace(source, '{SP}+', '', 'g'), regexp_replace(q, '{SP}+', '', 'g'))))) = 0, false) AS grounded0, source IS NULL AS unseen
        FROM analyses LEFT JOIN one USING (id, input_hash) WHERE interpretation IS NOT NULL)
        SELECT analysis_no, CASE WHEN NOT unseen THEN grounded0 END AS grounded FROM e""",
    "numbers_ungrounded": rf"""
        WITH {_SOURCE} SELECT analysis_no, array_to_string(list_filter(regexp_extract_all(coalesce(interpretation.summary, '') || coalesce(array_to_string(interpretation.key_points, ''), ''), '[0-9]+(?:\.[0-9]+)?'),
            lambda n: NOT contains(source, n)), '|') AS numbers FROM analyses LEFT JOIN one USING (id, input_hash) WHERE interpretation IS NOT NULL""",
    "interpretation_checks": rf"""
        WITH {_SOURCE}, i AS (SELECT analysis_no, interpretation AS x, source, regexp_replace(source, '{SP}+', '', 'g') AS bare FROM analyses LEFT JOIN one USING (id, input_hash) WHERE interpretation IS NOT NULL)
        SELECT analysis_no, CASE WHEN source IS NULL THEN 'source'
            WHEN NOT coalesce(length(x.summary) BETWEEN 1 AND 50, false) THEN 'summary'
            WHEN NOT coalesce(len(x.key_points) = 3 AND len(list_filter(x.key_points, lambda p: NOT length(p) > 0)) = 0, false) THEN 'key_points'
            WHEN NOT coalesce(len(list_filter(x.topics, lambda t: NOT list_contains({_TOPICS}, t))) = 0 AND len(list_distinct(x.topics)) = len(x.topics) AND len(x.topics) <= 3, false) THEN 'topics'
            WHEN NOT coalesce(len(list_filter(x.targets, lambda t: NOT list_contains({_TARGETS}, t))) = 0 AND len(list_distinct(x.targets)) = len(x.targets), false) THEN 'targets'
            WHEN NOT coalesce(x.impact.direction IN ('利好', '利空', '中性') AND length(x.impact.reason) > 0, false) THEN 'impact'
            WHEN NOT coalesce(len(x.evidence) = 3 AND len(list_filter(x.evidence, lambda q: NOT (length(q) >= 8 AND contains(bare, regexp_replace(q, '{SP}+', '', 'g'))))) = 0, false) THEN 'evidence'
            WHEN NOT coalesce(len(list_filter(regexp_extract_all(x.summary || array_to_string(x.key_points, '') || x.impact.reason, '[0-9]+(?:\.[0-9]+)?'), lambda n: NOT contains(source, n))) = 0, false) THEN 'numbers'
            END AS failure FROM i""",
    "text_truncate": f"""
        WITH {_SOURCE} SELECT record_id, length(source[1:1500]) AS chars, sha256(source[1:1500]) AS digest, array_to_string(list_filter([
            CASE WHEN content_status IS DISTINCT FROM 'complete' THEN 'body' END,
            CASE WHEN len(list_filter(attachments, lambda a: coalesce(a.status, '') <> 'parsed')) > 0 THEN 'attachments' END,
            CASE WHEN length(source) > 1500 THEN 'length' END], lambda r: r IS NOT NULL), '|') AS reasons FROM src""",
    "byte_guard": f"WITH {_SOURCE} SELECT record_id, strlen(source) AS bytes FROM src WHERE strlen(source) > 5000",
    "attachment_digests": f"""
        SELECT record_id, coalesce(attachments_hash, sha256('[' || coalesce(array_to_string(list_sort(list_transform(attachments, lambda a: '[' || {_json_items('a.url')} || ', ' || {_json_items('a.sha256')} || ', ' || {_json_items('a.status')}
                || ', ' || to_json(coalesce(a.text, ''))::VARCHAR || ']')), ', '), '') || ']')) AS digest,
            array_to_string(list_sort(list_transform(attachments, lambda a: a.url || ' ' || coalesce(a.sha256, ''))), '|') AS keys FROM policies""",
    "coverage_missing": """
        WITH f AS (SELECT DISTINCT column_id, id FROM policy_checks)
        SELECT column_id, count(*) AS discovered, count(*) FILTER (NOT EXISTS (SELECT 1 FROM policies p WHERE p.id = f.id AND p.content_status = 'complete')) AS missing FROM f GROUP BY column_id""",
    "semi_analysed": "SELECT record_id FROM policies p WHERE EXISTS (SELECT 1 FROM analyses a WHERE a.id = p.id AND a.status = 'complete' AND a.interpretation IS NOT NULL)",
    "column_membership": """
        SELECT h.column_id, h.name, h.status AS health, count(*) AS records FROM policies p JOIN column_health h ON list_contains(p.column_ids, h.column_id) GROUP BY ALL""",
    "id_columns": "SELECT id, string_agg(c, '|' ORDER BY c) AS column_ids FROM (SELECT DISTINCT id, unnest(column_ids) AS c FROM policies) GROUP BY id",
    "display_dates": f"SELECT record_id, {_DISPLAY} AS date, coalesce(nullif(trim(regexp_replace(coalesce(issuer, ''), '{SP}+', ' ', 'g')), ''), lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1), ''))) AS issuer FROM policies",
    "search_facets": f"""
        SELECT record_id, {_DISPLAY} AS date FROM policies WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(content_text, '')), '储能')
            AND contains(lower(coalesce(title, '') || ' ' || coalesce(content_text, '')), 'bms') AND {_DISPLAY} BETWEEN '2022-01-01' AND '2026-12-31'""",
    "search_array_facet": "SELECT record_id FROM policies WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(content_text, '')), '容量') AND list_contains(column_ids, 'xznb_interpretations') AND source_id = 'xznb'",
    "search_page": f"SELECT record_id, {_DISPLAY} AS date FROM policies WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(content_text, '')), '容量') ORDER BY date DESC, record_id LIMIT 12 OFFSET 12",
    "recent_30d": f"SELECT record_id, {_DISPLAY} AS date FROM policies WHERE {_DISPLAY} BETWEEN '2026-03-02' AND '2026-03-31'",
    "facet_issuers": f"SELECT trim(regexp_replace(coalesce(issuer, ''), '{SP}+', ' ', 'g')) AS value, count(*) AS n FROM policies WHERE trim(regexp_replace(coalesce(issuer, ''), '{SP}+', ' ', 'g')) <> '' GROUP BY 1",
    "related_top5": """
        WITH t AS (SELECT DISTINCT analysis_no, unnest(interpretation.topics) AS topic FROM analyses WHERE interpretation IS NOT NULL),
        few AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY topic ORDER BY analysis_no) <= 50),
        pairs AS (SELECT DISTINCT a.analysis_no, b.analysis_no AS other FROM t a JOIN few b USING (topic) WHERE a.analysis_no <> b.analysis_no)
        SELECT analysis_no, other, row_number() OVER (PARTITION BY analysis_no ORDER BY other) AS n FROM pairs QUALIFY n <= 5""",
    "set_operations": """
        WITH p AS (SELECT DISTINCT id FROM policies), c AS (SELECT DISTINCT id FROM policy_checks)
        SELECT 'union' AS kind, count(*) AS n FROM (FROM p UNION FROM c) UNION ALL SELECT 'both', count(*) FROM (FROM p INTERSECT FROM c)
        UNION ALL SELECT 'only_stored', count(*) FROM (FROM p EXCEPT FROM c) UNION ALL SELECT 'only_checked', count(*) FROM (FROM c EXCEPT FROM p)""",
    "seeded_sample": "SELECT record_id, md5(record_id || ':11') AS draw FROM policies ORDER BY draw, record_id LIMIT 10",
}
