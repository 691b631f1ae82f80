"""Keyword screening and counts over a taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import keyword_hits

# Default keywords and topics.
KEYWORDS = ["储能", "新型储能", "抽水蓄能", "分时电价", "峰谷", "尖峰", "代理购电", "容量电价", "容量补偿", "电力现货", "辅助服务", "调频", "调峰", "两个细则", "需求响应", "虚拟电厂", "负荷管理", "配储", "新能源上网电价", "电力市场"]
TOPICS = ["规划与发展目标", "分时电价与峰谷价差", "电力现货市场", "辅助服务", "容量补偿与容量电价", "需求响应与虚拟电厂", "新能源配储与并网", "补贴与示范项目", "安全管理与标准"]


def screened(rows: DataFrame, title: Column, body: Column, keywords: list[str] = KEYWORDS) -> DataFrame:
    """The rows with ``keywords``: those found in title or body, in the given order; attachments do not count."""
    text = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))
    return rows.withColumn("keywords", keyword_hits(text, keywords))


def counts_over(values: DataFrame, column: str, taxonomy: list[str]) -> DataFrame:
    """(topic, n) for every entry of the taxonomy, also where n is 0; other values are not counted.

    The taxonomy is a list of the caller's, so its side of the join is as small as that list.
    """
    spark = values.sparkSession
    known = spark.createDataFrame([(t,) for t in taxonomy], "topic string")
    counted = values.where(F.col(column).isin(*taxonomy)).groupBy(F.col(column).alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(counted, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def exploded_counts(rows: DataFrame, array: Column, taxonomy: list[str]) -> DataFrame:
    """``counts_over`` the elements of an array column."""
    return counts_over(rows.select(F.explode(array).alias("_t")), "_t", taxonomy)


def flag_counts(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: how many rows fulfil each condition; conditions may overlap."""
    return rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in flags.items()])
