"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bisect, boilerplate, encode, leakage, lookalike, nearcopy, residue, survivor
from loomwright.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_reading_pairs(table(spark, sf_dir, "policies"), "record_id", "title")


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, sf_dir, "policies"), "title")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisect.split_items(bisect.policy_items(table(spark, sf_dir, "policies")), ["record_id", "attachment_no"], "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an item was too long if it came out in more than one piece
    return p2_pieces(spark, sf_dir).where("piece_no = 2").select("record_id", "attachment_no")


def p2_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every item that was too long, whether its pieces are short enough, share 200 characters each and give the item again."""
    items = bisect.policy_items(table(spark, sf_dir, "policies")).where(F.length("text") > bisect.LIMIT)
    parts = items.select("record_id", "attachment_no", "text", bisect.pieces(F.col("text")).alias("p"))
    texts = F.transform("p", lambda x: x["text"])
    whole = F.aggregate(texts, F.lit(""), lambda so, t: F.when(F.length(so) == 0, t).otherwise(F.concat(so, F.substring(t, bisect.OVERLAP + 1, bisect.LIMIT))))
    shared = F.zip_with(F.slice(texts, 1, F.size(texts) - 1), F.slice(texts, 2, F.size(texts)), lambda a, b: F.right(a, F.lit(bisect.OVERLAP)) == F.substring(b, 1, bisect.OVERLAP))
    return parts.select(
        "record_id", "attachment_no", F.forall(texts, lambda t: F.length(t) <= bisect.LIMIT).alias("short"), F.forall(shared, lambda x: x).alias("shared"), F.sha2(whole, 256).alias("again"), (F.size("p") > 1).alias("cut")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.site_lines(table(spark, sf_dir, "policies"), "record_id", "id", "url", "content_text")


def p3_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.bodies(table(spark, sf_dir, "policies"), "record_id", "id", "url", "content_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = survivor.best_rows(table(spark, sf_dir, "policies"), table(spark, sf_dir, "analyses"))
    none = F.lit(0).cast("long")
    return best.select("id", F.coalesce("text", none).alias("text_record_id"), F.coalesce("date", none).alias("date_record_id"), F.coalesce("analysis", none).alias("analysis_no"))


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.survivors(table(spark, sf_dir, "policies"), table(spark, sf_dir, "analyses"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopy.similar_pairs(table(spark, sf_dir, "policies"), "record_id", "id", "title", "content_text")


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopy.classes(table(spark, sf_dir, "policies"), "record_id", "id", "title", "content_text")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaking_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 40 letters or digits of an item with at most two edits."""
    return leakage.leaking_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), errors=2)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id")


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_forms": p1_forms,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_invariants": p2_invariants,
    "p3_found": p3_found,
    "p3_bodies": p3_bodies,
    "p4_found": p4_found,
    "p4_survivors": p4_survivors,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_near": p8_near,
    "p9_found": p9_found,
    "p9_kinds": p9_kinds,
}

# the best rows of each id by the stated orders
_P4 = r"""
        WITH several AS (SELECT id FROM policies WHERE id IS NOT NULL GROUP BY id HAVING count(*) >= 2),
        p AS (SELECT *, try_cast(last_checked_at AS TIMESTAMPTZ) AS checked,
                     length(regexp_replace(coalesce(content_text, ''), '[\s\x{85}\x{0b}\p{Z}]', '', 'g')) AS chars FROM policies),
        t AS (SELECT id, record_id FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY
                CASE content_status WHEN 'complete' THEN 0 WHEN 'partial' THEN 1 WHEN 'image_only' THEN 2 WHEN 'failed' THEN 3 ELSE 4 END,
                chars DESC, checked DESC NULLS LAST, record_id) = 1),
        d AS (SELECT id, record_id FROM p
              WHERE regexp_full_match(publish_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(publish_date AS DATE) IS NOT NULL AND publish_date >= '0001'
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY checked DESC NULLS LAST, record_id) = 1),
        a AS (SELECT id, analysis_no FROM analyses QUALIFY row_number() OVER (PARTITION BY id ORDER BY
                CASE WHEN status = 'complete' AND interpretation IS NOT NULL THEN 0 WHEN status = 'irrelevant' THEN 1
                     WHEN status = 'pending_review' THEN 2 WHEN status = 'pending' THEN 3 ELSE 4 END,
                try_cast(analyzed_at AS TIMESTAMPTZ) DESC NULLS LAST, analysis_no) = 1)
"""

SQL: dict[str, str] = {
    "p6_found": r"""
        WITH d AS (SELECT record_id, id, regexp_replace(coalesce(title, '') || content_text, '[\s\x{85}\x{0b}\p{Z}]', '', 'g') AS t
                   FROM policies WHERE length(regexp_replace(content_text, '[\s\x{85}\x{0b}\p{Z}]', '', 'g')) >= 300),
        w AS (SELECT DISTINCT record_id, id, t[i:i + 4] AS w FROM (SELECT record_id, id, t, unnest(range(1, length(t) - 3)) AS i FROM d)),
        n AS (SELECT record_id, count(*) AS n FROM w GROUP BY 1),
        c AS (SELECT a.record_id AS x, b.record_id AS y, count(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.record_id < b.record_id AND a.id <> b.id GROUP BY ALL)
        SELECT x AS record_id_a, y AS record_id_b FROM c JOIN n p ON p.record_id = x JOIN n q ON q.record_id = y WHERE 5 * k >= 3 * (p.n + q.n - k)
    """,
    "p2_invariants": """
        WITH i AS (SELECT record_id, 0::BIGINT AS n, content_text AS t FROM policies UNION ALL
            SELECT record_id, n, text FROM (SELECT record_id, unnest(range(1, len(attachments) + 1)) AS n, unnest(attachments).text AS text FROM policies))
        SELECT record_id, n AS attachment_no, true AS short, true AS shared, sha256(t) AS again, true AS cut FROM i WHERE length(t) > 2000
    """,
    "p6_classes": r"""
        WITH d AS (SELECT record_id, regexp_replace(coalesce(title, '') || content_text, '[\s\x{85}\x{0b}\p{Z}]', '', 'g') AS t
                   FROM policies WHERE length(regexp_replace(content_text, '[\s\x{85}\x{0b}\p{Z}]', '', 'g')) >= 300),
        m AS (SELECT record_id, t, min(record_id) OVER (PARTITION BY t) AS class_id FROM d),
        w AS (SELECT DISTINCT class_id, t[i:i + 4] AS w FROM (SELECT class_id, t, unnest(range(1, length(t) - 3)) AS i FROM m WHERE record_id = class_id)),
        n AS (SELECT class_id, count(*) AS n FROM w GROUP BY 1),
        c AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.class_id <> b.class_id GROUP BY ALL),
        l AS (SELECT x AS class_id, count(*) AS links FROM c JOIN n p ON p.class_id = x JOIN n q ON q.class_id = y WHERE 5 * k >= 3 * (p.n + q.n - k) GROUP BY 1)
        SELECT record_id, class_id, coalesce(links, 0) AS links FROM m LEFT JOIN l USING (class_id)
    """,
    "p2_found": """
        SELECT record_id, 0::BIGINT AS attachment_no FROM policies WHERE length(content_text) > 2000
        UNION ALL
        SELECT record_id, n FROM (
            SELECT record_id, unnest(range(1, len(attachments) + 1)) AS n, unnest(attachments).text AS text FROM policies
        ) WHERE length(text) > 2000
    """,
    "p4_survivors": rf"""{_P4},
        v AS (SELECT id, record_id, regexp_replace(title, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g') AS title, regexp_replace(issuer, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g') AS issuer,
                (CASE content_status WHEN 'complete' THEN 1.0 WHEN 'partial' THEN 0.6 ELSE 0.3 END)
                * coalesce(pow(0.5, greatest(0, epoch(TIMESTAMPTZ '2026-12-31 00:00:00+00') - epoch(checked)) / 86400.0 / 180.0), 0) AS vote FROM p),
        ti AS (SELECT id, title FROM (SELECT id, title, round(sum(vote), 9) AS n, min(record_id) AS f FROM v WHERE title <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, f) = 1),
        iss AS (SELECT id, issuer FROM (SELECT id, issuer, round(sum(vote), 9) AS n, min(record_id) AS f FROM v WHERE issuer <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, f) = 1)
        SELECT t.id, x.content_status, x.content_text, y.publish_date, ti.title AS title, iss.issuer AS issuer, z.status AS analysis_status
        FROM t JOIN policies x ON x.record_id = t.record_id LEFT JOIN d ON d.id = t.id LEFT JOIN policies y ON y.record_id = d.record_id
        LEFT JOIN ti ON ti.id = t.id LEFT JOIN iss ON iss.id = t.id LEFT JOIN a ON a.id = t.id LEFT JOIN analyses z ON z.analysis_no = a.analysis_no
    """,
    "p4_found": rf"""{_P4}        SELECT s.id, t.record_id AS text_record_id, coalesce(d.record_id, 0) AS date_record_id, coalesce(a.analysis_no, 0) AS analysis_no
        FROM several s JOIN t USING (id) LEFT JOIN d USING (id) LEFT JOIN a USING (id)
    """,
}
