"""Integrity rules as rows of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import quotes_grounded, ungrounded_numbers


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key): one row for each rule that a row breaks; all rules in one pass. A rule that is null is not broken."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return rows.select(F.explode(broken).alias("rule"), key)


def duplicate_violations(rows: DataFrame, rule: str, columns: list[str], shown: Column) -> DataFrame:
    """(rule, value): values of the columns that stand more than once."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), shown.alias("value"))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The message of the first check that fails, null if all hold; a check that is null fails."""
    return reduce(lambda rest, check: F.when(~F.coalesce(check[1], F.lit(False)), F.lit(check[0])).otherwise(rest), reversed(checks), F.lit(None).cast("string"))


def interpretation_failure(reading: Column, source: Column, topics: list[str], targets: list[str]) -> Column:
    """Why a machine reading is not usable, null if it is: lengths, lists within the taxonomy and without repeats, three grounded quotes, no number of its own."""
    known = lambda field, allowed: (F.size(F.array_except(reading[field], F.array(*[F.lit(a) for a in allowed]))) == 0) & (F.size(F.array_distinct(reading[field])) == F.size(reading[field]))
    output = F.concat(reading["summary"], F.array_join(reading["key_points"], ""), reading["impact"]["reason"])
    return first_failure(
        [
            ("summary", F.length(reading["summary"]).between(1, 50)),
            ("key_points", (F.size(reading["key_points"]) == 3) & F.forall(reading["key_points"], lambda p: F.length(p) > 0)),
            ("topics", known("topics", topics) & (F.size(reading["topics"]) <= 3)),
            ("targets", known("targets", targets)),
            ("impact", reading["impact"]["direction"].isin("利好", "利空", "中性") & (F.length(reading["impact"]["reason"]) > 0)),
            ("evidence", (F.size(reading["evidence"]) == 3) & quotes_grounded(reading["evidence"], source)),
            ("numbers", F.size(ungrounded_numbers(output, source)) == 0),
        ]
    )


def missing_from(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key is not present."""
    return wanted.join(present.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def require(rows: DataFrame, what: str) -> DataFrame:
    """The rows; the query fails while running if there is any (an assertion that a set of violations is empty)."""
    return rows.where(F.assert_true(F.lit(False), F.lit(what)).isNull())


def required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows, with those columns alone; a missing column is an error before anything runs."""
    missing = sorted(set(columns) - set(rows.columns))
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    return rows.select(*columns)


def referential(children: DataFrame, parents: DataFrame, key: str, what: str) -> DataFrame:
    """Children joined with their parents; the query fails while running if a child has none."""
    marked = children.join(parents.withColumn("_there", F.lit(True)), key, "left")
    found = F.assert_true(F.col("_there").isNotNull(), F.concat(F.lit(f"{what}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    # the assertion has to be part of the result, or it would be pruned
    return marked.where(found.isNull()).drop("_there")


def column_presence(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, present) of the columns a step needs."""
    return rows.sparkSession.createDataFrame([(c, c in rows.columns) for c in columns], "name string, present boolean")
