from pyspark.sql import functions as F

from conftest import rows
from loomwright.llm import survivor

P = "record_id long, id string, title string, issuer string, publish_date string, content_text string, content_status string, last_checked_at string, vote string"
A = "analysis_no long, id string, status string, interpretation struct<summary:string>, analyzed_at string"


def tables(spark):
    p = [
        (1, "a", "T", None, "2024-01-02", "long text", "partial", "2026-01-01T00:00:00+00:00", ""),
        (2, "a", "T", "I", "2024-13-02", "x", "complete", "2026-01-02T00:00:00+00:00", ""),
        (3, "a", "U", "I", "2024-01-03", "x y", "complete", "2026-01-01T23:00:00-02:00", ""),
        (4, "a", " T ", "I", None, "x　y", "complete", "2026-01-02T01:00:00Z", ""),
        (5, "b", None, None, "", None, None, None, ""),
        (6, "b", None, None, "0000-01-01", None, None, None, ""),
        (7, "c", "once", "I", "2024-02-29", "t", "failed", "2026-01-01T00:00:00+00:00", ""),
        (8, None, "no id", "I", "2024-02-29", "t", "failed", "2026-01-01T00:00:00+00:00", ""),
    ]
    a = [
        (1, "a", "complete", None, "2026-05-01T00:00:00+00:00"),
        (2, "a", "irrelevant", None, None),
        (3, "a", "irrelevant", None, "2026-01-01T00:00:00+00:00"),
        (4, "a", "irrelevant", None, "2026-01-01T08:00:00+08:00"),
        (5, "z", "complete", ("s",), "2026-01-01T00:00:00+00:00"),
        (6, "b", None, None, None),
    ]
    return spark.createDataFrame(p, P), spark.createDataFrame(a, A)


def test_best_rows(spark):
    p, a = tables(spark)
    out = {r["id"]: r for r in survivor.best_rows(p, a).collect()}
    assert set(out) == {"a", "b"}
    # equal status, characters and instant: the smaller id; dates only where they exist
    assert (out["a"]["text"], out["a"]["date"], out["a"]["analysis"]) == (3, 3, 3)
    assert (out["b"]["text"], out["b"]["date"], out["b"]["analysis"]) == (5, None, 6)
    assert rows(survivor.best_rows(p.limit(0), a)) == [] and len(rows(survivor.best_rows(p, a.limit(0)))) == 2


def test_votes_decide_free_fields(spark):
    p, a = tables(spark)
    out = {r["id"]: r for r in survivor.survivors(p, a).collect()}
    # three rows say T (once with blanks around), one says U: the vote of the many wins, from its smallest row
    assert out["a"]["title"] == "T" and out["a"]["issuer"] == "I" and out["a"]["content_text"] == "x y"
    assert out["b"]["title"] is None and out["c"]["publish_date"] == "2024-02-29" and set(out) == {"a", "b", "c"}


def test_trust_and_age_weigh(spark):
    df = spark.createDataFrame([("k", 1, "old", 1.0, "2020-01-01"), ("k", 2, "old", 1.0, "2020-01-01"), ("k", 3, "new", 1.0, "2026-01-01"), ("k", 4, "", 9.0, "2026-01-01")], "key string, row long, value string, trust double, at string")
    long = survivor.long_rows(df, "key", "row", [survivor.Field("f", F.col("value"))], F.col("trust"), F.to_timestamp("at"), F.to_timestamp(F.lit("2026-01-01")))
    assert [r["row"] for r in survivor.winners(long).collect()] == [3]
