import hashlib
import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions import urls


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def many(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[1] for r in sorted(df.select("i", expression(F.col("v")).alias("x")).collect())]


def test_clean_and_compact(spark):
    assert many(spark, ["  a　\n b\x1c", None, "", "\xa0"], T.clean) == ["a b", "", "", ""]
    assert many(spark, ["a　 b", None], T.compact) == ["ab", None]
    assert many(spark, ["“甲”​ ﻿乙’", None], T.plain_title) == ["\"甲\"乙'", ""]
    assert many(spark, ["（２０２６）Ａ", None], T.normalized_title) == ["(2026)A", ""]


def test_dates(spark):
    texts = ["2026-2-30", "发布于2026年3月5日", "2026/03/05", "x", None, "", "2026.12.1 与 2025-01-01", "1999-01-01"]
    assert many(spark, texts, T.iso_date) == [None, "2026-03-05", "2026-03-05", None, None, None, "2026-12-01", None]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(*[st.one_of(st.none(), st.text(st.characters(codec="utf-8"), max_size=12))] * 3), min_size=1, max_size=20))
def test_fingerprint_is_the_json_digest(spark, values):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string, c string")
    out = {r[0]: r[1] for r in df.select("i", T.fingerprint("r-1", F.col("a"), F.col("b"), F.col("c"))).collect()}
    assert out == {i: hashlib.sha256(json.dumps(["r-1", *v], ensure_ascii=False).encode()).hexdigest() for i, v in enumerate(values)}


def test_parts_of_titles(spark):
    assert many(spark, ["某市能源局关于印发办法的通知（能规〔2026〕12号）", "无", None], lambda c: T.document_number(c, T.ANY_NUMBER)) == ["能规〔2026〕12号", None, None]
    assert many(spark, ["某市能源局关于印发", "关于某事", None], lambda c: T.title_issuer(c, T.ANY_ISSUER)) == ["某市能源局", None, None]
    assert many(spark, ["国家能源局综合司 关于印发", "国家能源局公告2026年第5号", "某市能源局关于"], T.title_issuer) == ["国家能源局综合司", "国家能源局", None]
    assert many(spark, ["国家能源局公告　2026年第5号", "公告2026年第5号", None], T.document_number) == ["国家能源局公告 2026年第5号", None, None]
    assert one(spark, "题", lambda c: T.relevance_text(c, F.lit("文" * 2100), F.array(F.lit("甲" * 1500), F.lit(None), F.lit("乙" * 600)))) == "题\n正文：\n" + "文" * 2000 + "\n附件解析文本：\n" + "甲" * 1500 + "\n" + "乙" * 499
    assert many(spark, ["a\n电监〔2025〕3号\nb", "x" + "\n" * 20 + "电监〔2025〕3号", None], T.standalone_number) == ["电监〔2025〕3号", None, None]


def test_grounding(spark):
    df = spark.createDataFrame([("共有12.5户，增长3%", "12.5 户以及3个", ["以 及3个 12.5 户以及3个"])], "o string, s string, q array<string>")
    row = df.select(T.ungrounded_numbers(F.col("o"), F.col("s")).alias("n"), T.quotes_grounded(F.array(F.lit("12.5户以及3 个")), F.col("s")).alias("g"), T.quotes_grounded(F.array(F.lit("短")), F.col("s")).alias("h")).first()
    assert row["n"] == [] and row["g"] is True and row["h"] is False


def test_keywords_terms_and_sizes(spark):
    assert one(spark, "新型储能与调频", lambda c: T.keyword_hits(c, ["调频", "储能", "峰谷"])) == ["调频", "储能"]
    assert one(spark, "BMS 储能", lambda c: T.all_terms(c, " bms  储能 ")) is True and one(spark, "x", lambda c: T.all_terms(c, "")) is True
    assert many(spark, ["/a/b.PDF?x=1", "noext", "a.tar.gz"], T.extension) == ["pdf", None, "gz"]
    assert one(spark, "汉字", lambda c: T.bytes_within(c, 5)) is False


URLS = {
    "HTTP://WWW.Example.com:80/a%7Eb%2f?b=2&a=1&utm_source=x&a=0#frag": "http://www.example.com/a~b%2F?a=1&a=0&b=2",
    "https://h.example": "https://h.example/",
    "https://h.example:8443/x": "https://h.example:8443/x",
    "http://secure.example/x": "https://secure.example/x",
    "http://secure.example:80/x": "https://secure.example/x",
    " https://h.example/中 文 ": "https://h.example/%E4%B8%AD%20%E6%96%87",
    "https://h.example/?q=&r": "https://h.example/?q=&r=",
    "https://h.example/100%": "https://h.example/100%",
    "https://h.example/?a=1%2&b=%E5%82%A8*~+x&&UTM_x=1": "https://h.example/?a=1%252&b=%E5%82%A8%2A~+x",
    "https://h.example/a%e5%82%a8'(x)": "https://h.example/a%E5%82%A8'(x)",
    "https://h.example:/x": "https://h.example/x",
    "ftp://h.example/": None,
    "https://u:p@h.example/": None,
    "https://h.example:99999/": None,
    "nothing": None,
    "": None,
}


def test_urls(spark):
    assert many(spark, list(URLS), lambda c: urls.normalize_url(c, ("secure.example",))) == list(URLS.values())
    assert many(spark, [None], urls.normalize_url) == [None]
    again = [u for u in URLS.values() if u]
    assert many(spark, again, lambda c: urls.normalize_url(c, ("secure.example",))) == again
    assert re.fullmatch("[0-9a-f]{64}", one(spark, "https://h.example/", urls.page_id))
    assert many(spark, ["HTTPS://H.example/x", "javascript:alert(1)", None], urls.safe_url) == ["HTTPS://H.example/x", None, None]
    assert one(spark, "https://h.example/?q=%E5%82%A8&page=2&q=b&empty=", urls.query_parameters) == {"q": "b", "page": "2", "empty": ""}
