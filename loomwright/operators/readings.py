"""The index of machine readings: which stored records have a current one, what it says, and the counts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import fingerprint, keyword_hits
from loomwright.operators import dedup, screen
from loomwright.session import instant

# What a reading may say of a record's relevance, and the classes that are shown.
RELEVANCE = {"direct": "直接相关", "indirect": "间接相关", "unrelated": "无关"}
SHOWN = ("直接相关", "间接相关")
TO_CHECK = "待核查"
#: Readings of one record and input, the best first; others come last.
STATUS_ORDER = ("complete", "irrelevant", "pending_review", "pending")


def stored_records(policies: DataFrame) -> DataFrame:
    """One row of each id: the one checked last among those that did not fail, else among all; ties by the smallest record_id.

    The row is chosen by its keys alone and joined back, so texts are not shuffled to choose it.
    """
    good = F.coalesce(F.col("content_status"), F.lit("")) != "failed"
    best = F.max(F.struct(good.alias("g"), instant(F.col("last_checked_at")).alias("t"), (-F.col("record_id")).alias("r"))).alias("b")
    chosen = policies.groupBy("id").agg(best).select((-F.col("b.r")).alias("record_id"))
    return policies.join(chosen, "record_id", "left_semi")


def with_fingerprint(stored: DataFrame, rule: str) -> DataFrame:
    """(id, input_hash): the fingerprint of each stored record under the rule."""
    return stored.select("id", fingerprint(rule, F.col("title"), F.col("content_hash"), F.col("attachments_hash")).alias("input_hash"))


def _rank(status: Column) -> Column:
    place = F.lit(len(STATUS_ORDER))
    for i, name in reversed(list(enumerate(STATUS_ORDER))):
        place = F.when(status == name, i).otherwise(place)
    return place


def saved_readings(stored: DataFrame, analyses: DataFrame, rule: str) -> DataFrame:
    """(id, current, relevance, status, review_status, complete, topics): of each stored record the best reading of its current input.

    A reading counts if its input_hash is the record's fingerprint under the rule; among several the best
    status, then the latest, then the smallest number.  Records without one have no row.
    """
    seen = with_fingerprint(stored, rule)
    order = F.struct(_rank(F.col("status")).alias("s"), (-F.coalesce(F.unix_micros(instant(F.col("analyzed_at"))), F.lit(0))).alias("t"), F.col("analysis_no").alias("n"))
    kept = F.struct(order.alias("o"), "relevance", "status", "review_status", F.col("interpretation.topics").alias("topics"))
    best = analyses.join(seen, ["id", "input_hash"], "left_semi").groupBy("id").agg(F.min_by(kept, kept["o"]).alias("k"))
    return best.select("id", F.lit(True).alias("current"), "k.relevance", "k.status", "k.review_status", "k.topics")


def reading_index(policies: DataFrame, analyses: DataFrame, completed: DataFrame, rule: str, keywords: list[str] = screen.KEYWORDS) -> DataFrame:
    """(id, record_id, canonical_id, keywords, relevance, status, visible, review_status, topics): one row for each stored record.

    status: that of the current reading of a record with keywords, ``pending`` where there is none,
    ``keyword_no_match`` without keywords.  visible: a complete current reading that calls it relevant.
    """
    stored = stored_records(policies)
    hits = keyword_hits(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content_text", F.lit(""))), keywords)
    slim = stored.select("id", "record_id", hits.alias("keywords"))
    groups = dedup.canonical(stored, completed).select("record_id", "canonical_id")
    joined = slim.join(groups, "record_id").join(saved_readings(stored, analyses, rule), "id", "left")
    hit, current = F.size("keywords") > 0, F.coalesce("current", F.lit(False))
    status = F.when(hit & current, F.coalesce("status", F.lit("pending"))).when(hit, "pending").otherwise("keyword_no_match")
    visible = hit & current & F.coalesce((F.col("status") == "complete") & F.col("relevance").isin(*SHOWN), F.lit(False))
    return joined.select("id", "record_id", "canonical_id", "keywords", "relevance", status.alias("status"), visible.alias("visible"), "review_status", "topics")


def canonical_hits(index: DataFrame) -> DataFrame:
    """The canonical records with keywords: what the counts are taken over."""
    return index.where((F.col("id") == F.col("canonical_id")) & (F.size("keywords") > 0))


def category_counts(index: DataFrame) -> DataFrame:
    """One row of counts over the canonical records with keywords: by relevance, undecided, and to check (which overlaps the others)."""
    r = F.col("relevance")
    flags = {name: r == value for name, value in RELEVANCE.items()} | {"undecided": ~F.coalesce(r.isin(*RELEVANCE.values()), F.lit(False)), "to_check": F.col("review_status") == TO_CHECK}
    return screen.flag_counts(canonical_hits(index), flags)


def topic_counts(index: DataFrame, topics: list[str] = screen.TOPICS) -> DataFrame:
    """(topic, n) over the complete current readings of canonical records with keywords, 0 included."""
    return screen.exploded_counts(canonical_hits(index).where("status = 'complete'"), F.col("topics"), topics)


def index_summary(index: DataFrame) -> DataFrame:
    """One row: total (groups), raw_total (records), merged_records, keyword_matches (canonical ones)."""
    canonical = F.col("id") == F.col("canonical_id")
    counts = index.agg(F.count_if(canonical).alias("total"), F.count(F.lit(1)).alias("raw_total"), F.count_if(canonical & (F.size("keywords") > 0)).alias("keyword_matches"))
    return counts.select("total", "raw_total", (F.col("raw_total") - F.col("total")).alias("merged_records"), "keyword_matches")


def topic_shares(index: DataFrame, topics: list[str] = screen.TOPICS) -> DataFrame:
    """(topic, n, share): topics of the visible canonical records, 0 included, and n against the largest n (1 at least)."""
    counts = screen.exploded_counts(index.where("visible AND id = canonical_id"), F.col("topics"), topics)
    # one row for each topic of a list of the caller's
    scale = counts.agg(F.greatest(F.lit(1), F.max("n")).alias("scale"))
    return counts.crossJoin(F.broadcast(scale)).select("topic", "n", F.round(F.col("n") / F.col("scale"), 6).alias("share"))
