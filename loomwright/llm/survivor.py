"""One surviving record for each group of duplicates, chosen field by field.

Records are unpivoted to long rows (key, field, value, row), every row votes for its normalised
value with source trust times recency decay, votes are summed by value, and ``max_by`` picks each
field's winner; the winners are pivoted back.

A field may have an order instead (``rank``: any comparable column, the larger the better), as the
project states one for its four fields; its votes then only describe the winner.

Both aggregations combine before they shuffle: a key with a third of all rows reaches the reducers
as one partial row for each task and value.  Long rows carry row ids and hashes, never whole texts.

Defined results: null keys form no group; a null or empty candidate value is no candidate; a field
without candidates is null; ties go to the smallest row id; rows stated twice vote twice; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.session import instant, no_white, stripped

#: Age in days after which a vote counts half.
HALF_LIFE_DAYS = 180.0


@dataclass(frozen=True)
class Field:
    """One field to fuse.  value: the normalised value voted for; rank: the order that decides instead of the votes."""

    name: str
    value: Column
    rank: Column | None = None
    valid: Column | None = None


def _rank(a: Column, b: Column, c: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("long").alias("b"), c.alias("c"))


def long_rows(rows: DataFrame, key: str, row_id: str, fields: list[Field], trust: Column, at: Column, now: Column) -> DataFrame:
    """(key, field, value, row, rank, voted, vote): one row for each candidate value of each record.

    All fields of one call need ranks of one type (or none).
    """
    age = F.greatest(F.lit(0.0), (now.cast("double") - at.cast("double")) / 86400.0)
    vote = F.coalesce(trust.cast("double"), F.lit(1.0)) * F.coalesce(F.pow(F.lit(0.5), age / HALF_LIFE_DAYS), F.lit(0.0))
    entries = [
        F.struct(
            F.lit(f.name).alias("field"),
            F.xxhash64(f.value.cast("string")).alias("value"),
            (f.rank if f.rank is not None else _rank(F.lit(0), F.lit(0), F.lit(None).cast("timestamp"))).alias("rank"),
            F.lit(f.rank is None).alias("voted"),
            F.when((f.valid if f.valid is not None else (f.value.isNotNull() & (f.value.cast("string") != ""))), F.lit(True)).otherwise(F.lit(False)).alias("valid"),
        )
        for f in fields
    ]
    unpivoted = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(row_id).alias("row"), vote.alias("vote"), F.explode(F.array(*entries)).alias("e"))
    return unpivoted.where("e.valid").select("key", "row", "vote", "e.field", "e.value", "e.rank", "e.voted")


def winners(long: DataFrame) -> DataFrame:
    """(key, field, row, votes): the winning row of every field."""
    by_value = long.groupBy("key", "field", "value").agg(
        F.sum("vote").alias("votes"),
        F.first("voted").alias("voted"),
        F.max(F.struct("rank", (-F.col("row")).alias("first"))).alias("best"),
    )
    order = F.struct(F.col("best.rank").alias("rank"), F.when(F.col("voted"), F.round("votes", 9)).otherwise(0.0).alias("weight"), F.col("best.first").alias("first"), F.col("votes"))
    return by_value.groupBy("key", "field").agg(F.max(order).alias("won")).select("key", "field", (-F.col("won.first")).alias("row"), F.col("won.votes").alias("votes"))


def pivoted(won: DataFrame, names: list[str]) -> DataFrame:
    """(key, one column of row ids for each field)."""
    return won.groupBy("key").pivot("field", names).agg(F.max("row"))


def ordered(column: str, best_first: list[str]) -> Column:
    """Rank of an enumerated value: the first is the largest, anything else is 0."""
    rank = F.lit(0)
    for place, value in enumerate(best_first):
        rank = F.when(F.col(column) == value, F.lit(len(best_first) - place)).otherwise(rank)
    return rank


def real_date(column: str) -> Column:
    """Whether the string is an existing date written YYYY-MM-DD in ASCII digits."""
    shape = F.rlike(F.col(column), F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z")) & ~F.startswith(F.col(column), F.lit("0000"))
    return F.coalesce(shape & F.try_to_timestamp(F.when(shape, F.col(column)), F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


#: The day by which votes are aged where the caller names none.
VOTE_DAY = "2026-12-31 00:00:00"


def policy_votes(policies: DataFrame, analyses: DataFrame, day: str = VOTE_DAY) -> DataFrame:
    """Long rows of the project's four fields, and of title and issuer, which go by votes alone, aged up to ``day``."""
    checked = instant(F.col("last_checked_at"))
    status = ["complete", "partial", "image_only", "failed"]
    zero = F.lit(0)
    trust = F.when(F.col("content_status") == "complete", 1.0).when(F.col("content_status") == "partial", 0.6).otherwise(0.3)
    chars = F.length(F.coalesce(no_white(F.col("content_text")), F.lit("")))
    fields = [
        Field("text", F.coalesce("content_text", F.lit("")), _rank(ordered("content_status", status), chars, checked), F.lit(True)),
        Field("date", F.col("publish_date"), _rank(zero, zero, checked), real_date("publish_date")),
        Field("title", stripped("title")),
        Field("issuer", stripped("issuer")),
    ]
    now = F.to_timestamp(F.lit(day))
    rows = long_rows(policies, "id", "record_id", fields, trust, checked, now)
    done = F.when((F.col("status") == "complete") & F.col("interpretation").isNotNull(), "interpreted").when(F.col("status") != "complete", F.col("status"))
    read = analyses.withColumn("_done", done)
    analysed = instant(F.col("analyzed_at"))
    analysis = [Field("analysis", F.col("status"), _rank(ordered("_done", ["interpreted", "irrelevant", "pending_review", "pending"]), zero, analysed), F.lit(True))]
    return rows.unionByName(long_rows(read, "id", "analysis_no", analysis, F.lit(1.0), analysed, now))


def best_rows(policies: DataFrame, analyses: DataFrame) -> DataFrame:
    """(id, text, date, analysis, title, issuer): the winning row of each field, for ids stored more than once."""
    several = policies.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(F.col("id").alias("key"))
    won = winners(policy_votes(policies, analyses))
    return pivoted(won, ["text", "date", "analysis", "title", "issuer"]).join(several, "key", "left_semi").withColumnRenamed("key", "id")


def survivors(policies: DataFrame, analyses: DataFrame, day: str = VOTE_DAY) -> DataFrame:
    """One record for each id: every field from the row that won it; votes are aged up to ``day``."""
    won = pivoted(winners(policy_votes(policies, analyses, day)), ["text", "date", "analysis", "title", "issuer"])
    p = policies.select("record_id", "content_status", "content_text", "publish_date", "title", "issuer")
    take = lambda field, *columns: p.select(F.col("record_id").alias(field), *columns)
    return (
        won.join(take("text", "content_status", "content_text"), "text", "left")
        .join(take("date", "publish_date"), "date", "left")
        .join(take("title", stripped("title").alias("best_title")), "title", "left")
        .join(take("issuer", stripped("issuer").alias("best_issuer")), "issuer", "left")
        .join(analyses.select(F.col("analysis_no").alias("analysis"), F.col("status").alias("analysis_status")), "analysis", "left")
        .where(F.col("text").isNotNull())
        .select(F.col("key").alias("id"), "content_status", "content_text", "publish_date", F.col("best_title").alias("title"), F.col("best_issuer").alias("issuer"), "analysis_status")
    )
