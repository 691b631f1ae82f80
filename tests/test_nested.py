from pyspark.sql import functions as F

from conftest import rows
from loomwright.functions import dates
from loomwright.operators import nested

M = "array<struct<s:string,c:string,t:string>>"


def test_members(spark):
    df = spark.createDataFrame([(1, [("x", "a", "1"), ("x", "b", "1")], [("x", "b", "2"), ("w", "z", "2")]), (2, None, [("x", "a", "n")]), (3, [("x", "a", "o")], None), (4, None, None)], f"i int, old {M}, new {M}")
    out = {r["i"]: r for r in df.select("i", nested.upserted(F.col("old"), F.col("new"), ["s", "c"]).alias("u"), nested.pruned(F.col("old"), "c", ["b"]).alias("p"), nested.any_of(F.col("old"), "c", ["b"]).alias("any")).collect()}
    plain = lambda a: None if a is None else [tuple(x) for x in a]
    assert plain(out[1]["u"]) == [("w", "z", "2"), ("x", "a", "1"), ("x", "b", "2")] and plain(out[2]["u"]) == [("x", "a", "n")] and plain(out[3]["u"]) == [("x", "a", "o")] and out[4]["u"] is None
    assert plain(out[1]["p"]) == [("x", "b", "1")] and [out[i]["any"] for i in (1, 2, 3, 4)] == [True, False, False, False]


def test_metadata_lines_and_candidates(spark):
    kind = "array<struct<name:string,url:string,status:string>>"
    df = spark.createDataFrame([([("a", "u", "parsed")], '{"id": "1", "name": "b.pdf", "path": "/f/b.pdf"}'), ([("a", "u", "parsed")], "broken"), (None, '{"path": "c"}')], f"a {kind}, j string")
    assert [[x["url"] for x in r[0]] for r in df.select(nested.with_metadata(F.col("a"), F.col("j"), "https://h.example/")).collect()] == [["u", "https://h.example/f/b.pdf"], ["u"], ["https://h.example/c"]]
    text = spark.createDataFrame([("1\n\n2\n3\n 4\n5",), ("1\n2",), ("",), (None,)], "t string")
    assert [r[0] for r in text.select(nested.edge_lines(F.col("t"))).collect()] == [["1", "2", " 4", "5"], ["1", "2"], [], None]
    pages = spark.createDataFrame([("x" * 100, 3), ("x" * 99, 3), ("x" * 100 + "CAPTCHA", 3), (None, 9)], "t string, n int")
    assert [r[0] for r in pages.select(nested.candidate_page(F.col("t"), F.col("n"), ["captcha"])).collect()] == [True, False, False, False]
    e = spark.createDataFrame([(1, "2020-01-01"), (2, None), (3, "2021-01-01"), (4, None)], "i int, d string")
    assert [r["i"] for r in e.orderBy(*nested.entry_order("d", "i")).collect()] == [2, 4, 3, 1]


def test_times(spark):
    df = spark.createDataFrame([("2026-01-01T16:30:00Z",), ("2026-01-01T07:59:59+00:00",), ("",), (None,), ("soon",)], "t string")
    assert [r[0] for r in df.select(dates.local_time(F.col("t"))).collect()] == ["2026-01-02 00:30", "2026-01-01 15:59", "暂无记录", "暂无记录", "时间无效"]
    at = spark.createDataFrame([("2026-01-01T08:00:00Z",), ("2026-01-01T07:59:59Z",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert [str(r[0]) for r in at.select(dates.as_of_day(F.col("t"))).collect()] == ["2026-01-01", "2025-12-31"]
    assert dates.config_digest({"a": 1, "b": [2]}) == dates.config_digest({"b": [2], "a": 1})
    assert rows(spark.range(1).select(dates.label(F.lit("x"), {"y": "z"}), dates.label(F.lit("y"), {"y": "z"}))) == [("x", "z")]
