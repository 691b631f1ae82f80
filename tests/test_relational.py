import random

from pyspark.sql import functions as F

from conftest import rows
from loomwright.functions import urls
from loomwright.operators import relational, series


def test_percentiles_equal_the_built_in_ones(spark):
    r = random.Random(1)
    data = [("a" if i % 3 else None, r.choice([r.random() * 100, 5.0, None])) for i in range(500)] + [("one", 7.5), ("same", 2.0), ("same", 2.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        for cells in (1, 7, 4096):
            found = relational.exact_percentile(df, ["k"], "v", share, "p", cells).select("k", F.round("p", 9).alias("p"))
            assert rows(found) == rows(df.groupBy("k").agg(F.round(F.percentile("v", share), 9).alias("p"))), (share, cells)
    assert rows(relational.exact_percentile(df.limit(0), ["k"], "v", 0.5, "p")) == []


def test_nearest_vectors_as_brute_force(spark):
    r = random.Random(2)
    data = [(i, [float(r.randrange(-3, 4)) for _ in range(5)]) for i in range(120)] + [(200, [0.0] * 5), (201, None)]
    df = spark.createDataFrame(data, "i long, v array<float>").repartition(5)
    known = {i: v for i, v in data if v and any(v)}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    queries = df.where("i % 10 = 0 OR i > 199")
    for block in (4096, 5):
        found = rows(relational.nearest_vectors(df, queries, "i", "v", 4, block))
        asked = [q for q in known if q % 10 == 0]
        assert {f[0] for f in found} == set(asked)
        for q in asked:
            best = sorted((round(cosine(known[q], v), 9) for i, v in known.items() if i != q), reverse=True)[:4]
            assert sorted((round(f[2], 9) for f in found if f[0] == q), reverse=True) == best
    assert rows(relational.nearest_vectors(df.limit(0), queries, "i", "v", 4)) == [] and rows(relational.nearest_vectors(df, queries.limit(0), "i", "v", 4)) == []


def test_addresses_against_their_page(spark):
    cases = [("https://h.example/a/b.html?q#f", "c.html", "https://h.example/a/c.html"), ("https://h.example/a/", "/d", "https://h.example/d"), ("https://h.example", "x", "https://h.example/x"), ("http://h.example/a", "//o.example/y", "http://o.example/y"), ("http://h.example/a", "https://z/", "https://z/")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, base string, address string, expected string")
    assert rows(df.where(urls.absolute(F.col("base"), F.col("address")) != F.col("expected"))) == []
    assert rows(spark.range(1).select(urls.link("/base/", F.lit("/a/")), urls.link("", F.lit("b")), urls.link("/x", F.lit(None).cast("string")))) == [("/base/a/", "/b", "/x/")]
    assert rows(spark.range(1).select(urls.query_string(F.create_map(F.lit("q"), F.lit("储 能"), F.lit("e"), F.lit(""), F.lit("a"), F.lit("1"))))) == [("a=1&q=%E5%82%A8+%E8%83%BD",)]


def test_spreads_and_date_axes(spark):
    df = spark.createDataFrame([(150.55, 117.546875, 28.416875, True), (150.55, 117.546875, 28.416875, False), (1.0, 2.0, 3.0, None)], "s double, p double, v double, l boolean")
    out = series.spreads(df, F.col("s"), F.col("p"), F.col("v"), F.col("l"))
    assert [r[-2:] for r in rows(out)] == [(-0.01, None), (0.8913, None), (0.8913, 1.2213)]
    days = spark.createDataFrame([("2026-01-01",), ("2026-01-11",), ("2026-01-06",)], "d string").select(F.to_date("d").alias("d"))
    assert [r[1] for r in rows(series.date_axis(days, "d", 100.0, 50.0))] == [100.0, 125.0, 150.0] and rows(series.date_axis(days.limit(1), "d", 100.0, 50.0).select("x")) == [(100.0,)]
    checks = spark.createDataFrame([("2026-06-01", True)], "last_day string, valid boolean").select(F.to_date("last_day").alias("last_day"), "valid")
    assert [rows(series.not_older(checks, last).select("fresh", "valid")) for last in (None, "2026-06-01", "2026-06-02")] == [[(True, True)], [(True, True)], [(False, False)]]
