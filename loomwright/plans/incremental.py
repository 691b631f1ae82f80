"""Queries of incremental processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.text import fingerprint
from loomwright.operators import incremental
from loomwright.session import instant, scratch, table

RULE_VERSION = "storage-rules-4"


def _not_failed():
    return F.coalesce(F.col("content_status"), F.lit("")) != "failed"


def to_analyse(policies: DataFrame, analyses: DataFrame, rule: str = RULE_VERSION) -> DataFrame:
    """(id): policies whose latest good row no finished analysis has seen under this rule."""
    seen = fingerprint(rule, F.col("title"), F.col("content_hash"), F.col("attachments_hash")).alias("input_hash")
    latest = incremental.latest_rows(policies, "id", [instant(F.col("last_checked_at")), -F.col("record_id")], [F.col("title"), F.col("content_hash"), F.col("attachments_hash")], _not_failed())
    finished = analyses.where(F.col("status").isin("complete", "irrelevant")).select("id", "input_hash").distinct()
    return latest.select("id", seen).join(finished, ["id", "input_hash"], "left_anti").select("id")


def _order():
    return [instant(F.col("last_checked_at")), F.col("check_id")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "runs")
    collected = incremental.changes_by_run(table(spark, sf_dir, "policy_checks"), incremental.succeeded_runs(runs, "collect"), "id", "arrived_at", _order(), ["content_hash", "attachments_hash"], _not_failed())
    # the run log has few pending runs; each takes every wanted id
    pending = sorted({r["run_id"] for r in runs.where((F.col("kind") == "analyse") & (F.col("status") == "pending")).select("run_id").collect()})
    wanted = to_analyse(table(spark, sf_dir, "policies"), table(spark, sf_dir, "analyses"))
    names = F.array(*[F.lit(r) for r in pending]) if pending else F.array().cast("array<string>")
    return collected.unionByName(wanted.select(F.explode(names).alias("run_id"), "id"))


def p5_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state table after two refreshes, one at the cutoff of the run before the last, one at the last."""
    runs = incremental.succeeded_runs(table(spark, sf_dir, "runs"), "collect")
    checks, path = table(spark, sf_dir, "policy_checks"), scratch(spark, "state")

    def state(rows: DataFrame) -> DataFrame:
        return incremental.latest_rows(rows, "id", _order(), [F.col("content_hash"), F.col("attachments_hash"), F.col("check_id")], _not_failed())

    for _, cutoff in runs[-2:]:
        incremental.refresh(checks.where(F.col("arrived_at") <= F.lit(cutoff)), "id", ["check_id", "content_hash", "attachments_hash", "last_checked_at", "content_status"], state, path)
    return spark.read.parquet(f"{path}/data").select("id", "content_hash", "attachments_hash", "check_id")


QUERIES = {"p5_found": p5_found, "p5_state": p5_state}

_BEST = "ORDER BY try_cast(last_checked_at AS TIMESTAMPTZ) DESC NULLS LAST, check_id DESC"
SQL = {
    "p5_found": """
        WITH r AS (SELECT run_id, cutoff_at, row_number() OVER (ORDER BY cutoff_at, started_at) AS n FROM runs WHERE kind = 'collect' AND status = 'succeeded'),
        f AS (SELECT c.id, r.run_id, r.n, struct_pack(t := coalesce(try_cast(c.last_checked_at AS TIMESTAMPTZ), TIMESTAMPTZ '0001-01-01 00:00:00+00'), k := c.check_id, c := c.content_hash, a := c.attachments_hash) AS s
              FROM policy_checks c ASOF JOIN r ON c.arrived_at <= r.cutoff_at WHERE c.content_status IS DISTINCT FROM 'failed'),
        g AS (SELECT id, run_id, n, arg_max(s, struct_pack(t := s.t, k := s.k)) AS s FROM f GROUP BY ALL),
        w AS (SELECT id, run_id, n, arg_max(s, struct_pack(t := s.t, k := s.k)) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS s FROM g),
        v AS (SELECT *, lag(s) OVER (PARTITION BY id ORDER BY n) AS b FROM w),
        cases AS (SELECT run_id, id FROM v WHERE b IS NULL OR s.c IS DISTINCT FROM b.c OR s.a IS DISTINCT FROM b.a),
        p AS (SELECT * FROM policies WHERE content_status IS DISTINCT FROM 'failed'
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY try_cast(last_checked_at AS TIMESTAMPTZ) DESC NULLS LAST, record_id) = 1),
        h AS (SELECT id, sha256('["storage-rules-4", ' || coalesce(to_json(title)::VARCHAR, 'null') || ', ' || coalesce('"' || content_hash || '"', 'null')
                     || ', ' || coalesce('"' || attachments_hash || '"', 'null') || ']') AS h FROM p)
        SELECT run_id, id FROM cases
        UNION ALL
        SELECT runs.run_id, h.id FROM h, runs WHERE runs.kind = 'analyse' AND runs.status = 'pending'
          AND NOT EXISTS (SELECT 1 FROM analyses a WHERE a.id = h.id AND a.input_hash = h.h AND a.status IN ('complete', 'irrelevant'))
    """,
    "p5_state": f"""
        SELECT id, content_hash, attachments_hash, check_id FROM policy_checks
        WHERE content_status IS DISTINCT FROM 'failed'
          AND arrived_at <= (SELECT max(cutoff_at) FROM runs WHERE kind = 'collect' AND status = 'succeeded')
        QUALIFY row_number() OVER (PARTITION BY id {_BEST}) = 1
    """,
}
