import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from loomwright.operators import budget, dedup, merge, quality, relational, screen, search, series, tasks


def test_groups(spark):
    p = spark.createDataFrame(
        [
            (1, "a", "u1", "“题”", "2026-01-01", "xx", "complete", ["c"]), (2, "b", "u2", '"题"　', "2026-01-01", "x", "complete", ["d"]), (3, "c", "u3", "题", None, "", "partial", None),
            (4, "d", "u4", "题", None, "", "partial", []), (5, "e", "u5", "题", "", "", "partial", []), (6, "f", "u6", '"题"', "2026-01-01", None, None, []),
        ],
        "record_id long, id string, url string, title string, publish_date string, content_text string, content_status string, column_ids array<string>",
    )
    none = spark.createDataFrame([], "id string")
    out = {r["record_id"]: r["canonical_record"] for r in dedup.canonical(p, none).collect()}
    assert out == {1: 1, 2: 1, 6: 1, 3: 3, 4: 4, 5: 5}
    done = spark.createDataFrame([("b",), ("b",)], "id string")
    assert {r["canonical_id"]: list(r["member_ids"]) for r in dedup.groups(p, done).collect()}["b"] == ["b", "a", "f"]
    assert rows(dedup.summary(p, none)) == [(4, 6, 2)] and rows(dedup.summary(p.limit(0), none)) == [(0, 0, 0)]


def test_counts_over_a_taxonomy(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", "zz"],), (None,), ([],)], "t array<string>")
    assert rows(screen.exploded_counts(df, F.col("t"), ["a", "b", "c"])) == [("a", 2), ("b", 1), ("c", 0)]


def test_search(spark):
    items = spark.createDataFrame([(1, "BMS 储能", ["x"], "2026-01-01"), (2, "储能", ["y"], ""), (3, "bms储能", ["x", "y"], "2025-01-01")], "id int, text string, tags array<string>, date string")
    ids = lambda f: [r[0] for r in rows(search.matching(items, f).select("id"))]
    assert ids(search.Facets()) == [1, 2, 3] and ids(search.Facets(" bms 储能")) == [1, 3] and ids(search.Facets(arrays=(("tags", "y"), ("tags", "")))) == [2, 3]
    assert ids(search.Facets(since="2025-01-01")) == [1, 3] and ids(search.Facets(until="2025-06-01")) == [3]
    many = spark.range(30)
    assert [r[0] for r in search.page(many, [F.desc("id")], 99).collect()] == [5, 4, 3, 2, 1, 0] and [r[0] for r in search.page(many, [F.asc("id")], 0).collect()] == list(range(12))
    assert search.page(many.limit(0), [F.asc("id")], 3).collect() == []
    dates = spark.createDataFrame([("2026-03-31",), ("2026-03-02",), ("2026-03-01",), ("2026-04-01",), ("",)], "date string")
    assert len(rows(search.recent(dates, "date", "2026-03-31"))) == 2


def test_related_equals_brute_force(spark):
    data = [(i, [f"t{i % 3}", f"t{i % 7}"] if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(data, "id long, tags array<string>")
    found = rows(search.related(df, "id", "tags", [F.col("id")]))
    expected = []
    for i, own in data:
        others = [j for j, theirs in data if own and theirs and i != j and set(own) & set(theirs)]
        expected += [(i, j, n) for n, j in enumerate(others[:5], 1)]
    assert found == sorted(expected)


def test_as_of(spark):
    d = lambda s: datetime.date.fromisoformat(s)
    s = spark.createDataFrame([(d("2026-09-01"), 433.0), (d("2026-09-03"), 440.0), (d("2026-10-02"), 464.0)], "day date, value double")
    row = series.as_of_change(s).first()
    # no price at the target day: the trading day before counts
    assert (row["target_day"], row["baseline_day"], row["change_pct"]) == (d("2026-09-02"), d("2026-09-01"), round((464 / 433 - 1) * 100, 4))
    assert series.as_of_change(s.where("value > 450")).first()["change_pct"] is None
    left = spark.createDataFrame([("k", 5), ("k", 1), ("z", 9)], "k string, at int")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 6, "c")], "k string, at int, v string")
    assert rows(series.as_of_join(left, right, "at", ["k"], "v")) == [("k", 1, None, None), ("k", 5, 5, "b"), ("z", 9, None, None)]


def test_segments_deltas_and_scale(spark):
    s = spark.createDataFrame([("2026-01", None), ("2026-02", 1.0), ("2026-03", 2.0), ("2026-04", None), ("2026-05", 3.0), ("2026-06", None), ("2026-07", 4.0), ("2026-08", 5.0)], "m string, v double")
    assert [(r["m"][-2:], r["segment"], r["points"]) for r in series.segments(s, "m", "v").orderBy("m").collect()] == [("02", 1, 2), ("03", 1, 2), ("05", 2, 1), ("07", 3, 2), ("08", 3, 2)]
    assert [r["delta"] for r in series.deltas(s.where("v IS NOT NULL"), "m", "v").orderBy("m").collect()] == [None, 1.0, 1.0, 1.0, 1.0]
    flat = spark.createDataFrame([(1, 7.0), (2, 7.0)], "i int, v double")
    assert [r["y"] for r in series.scaled(flat, "v").collect()] == [120.0, 120.0] and len(series.ticks(flat, "v").collect()) == 5


@pytest.mark.parametrize(("change", "valid"), [(None, True), ("conflict", False), ("nan", False), ("negative", False), ("short", False), ("late", False)])
def test_series_validation(spark, change, valid):
    end = datetime.date(2026, 9, 30)
    data = [(end - datetime.timedelta(days=i), 100.0 + i) for i in range(366)]
    data = {"conflict": [*data, (end, 1.0)], "nan": [*data, (end, float("nan"))], "negative": [(data[0][0], -1.0), *data[1:]], "short": data[::3], "late": data[:300]}.get(change, data)
    out = series.validation(spark.createDataFrame(data, "day date, price double"), "day", "price", "2026-09-30").first()
    assert out["valid"] is valid


def test_streak(spark):
    df = spark.createDataFrame([("a", i, k) for i, k in enumerate([True, False, True, True, True, False])] + [("b", 0, False), ("b", 1, None)], "c string, pos int, known boolean")
    assert [r[1] for r in rows(tasks.until_streak(df, ["c"], [F.col("pos")], F.col("known"), 2).select("c", "pos"))] == [0, 1, 2, 3, 0, 1]


def test_interleaving_and_rechecks(spark):
    df = spark.createDataFrame(list(enumerate("aabacb", 1)), "pos int, host string")
    assert "".join(r["host"] for r in tasks.interleaved(df, F.col("host"), "pos").orderBy("round", "host_place").collect()) == "abcaba"
    t = spark.createDataFrame([(1, "2026-01-01 00:00:00", False), (2, "2026-01-09 12:00:00", False), (3, "2026-01-09 00:00:00", True), (4, None, False), (5, "2025-12-31 00:00:00", None)], "id int, at string, bad boolean")
    due = tasks.recheck_due(t, "id", F.to_timestamp("at"), F.col("bad"), "2026-01-10 00:00:00", 7, 3)
    assert [r["id"] for r in due.collect()] == [4, 5, 1]


def test_tasks(spark):
    e = spark.createDataFrame([("p", None), ("p", "2020-01-01"), ("q", "2020-01-01")], "page string, d string")
    assert rows(tasks.since(e, "d", "2021-01-01")) == [("p", None)] and rows(tasks.before_boundary(e, ["page"], "d", "2021-01-01")) == [("p", False), ("q", True)]
    pending = spark.createDataFrame([("u", "old", "c1", 9), ("v", "v", "c1", 1)], "url string, title string, col string, n int")
    found = spark.createDataFrame([("u", "new", "c2", 1), ("u", "new", "c1", 1)], "url string, title string, col string, n int")
    assert rows(tasks.merged_tasks(pending, found, "url", ["title"], "col", "n")) == [("u", "new", ["c1", "c2"]), ("v", "v", ["c1"])]
    stored = spark.createDataFrame([("u", ["c1"], "complete"), ("v", ["c1"], "failed")], "url string, cols array<string>, st string")
    known = tasks.known_here(found.select("url", "col").unionByName(pending.select("url", "col").where("url = 'v'")), stored, "url", "col", "cols", F.col("st") != "failed")
    assert rows(known.select("url", "col", "known")) == [("u", "c1", True), ("u", "c2", False), ("v", "c1", False)]


def test_versions(spark):
    data = [("x", 1, "failed", None, None), ("x", 2, "ok", "h1", "a1"), ("x", 3, "failed", None, None), ("x", 4, "ok", "h1", "a1"), ("x", 5, "ok", "h2", "a1"), ("x", 6, "ok", "h2", None), ("y", 1, "ok", None, None), ("y", 2, "ok", None, None)]
    df = spark.createDataFrame(data, "id string, n int, st string, h string, a string")
    out = [(r["event"], r["change_type"]) for r in merge.version_history(df, "id", [F.col("n")], F.col("st") == "failed", "h", "a").orderBy("id", "n").collect()]
    assert out == [("failed", None), ("updated", "recovery"), ("failed", None), ("unchanged", None), ("updated", "content"), ("updated", "attachments"), ("new", None), ("unchanged", None)]
    runs = merge.failure_runs(df, "id", [F.col("n")], F.col("st") == "failed", "n").orderBy("id", "n").collect()
    assert [(r["failures"], r["last_success"]) for r in runs] == [(1, None), (0, 2), (1, 2), (0, 4), (0, 5), (0, 6), (0, 1), (0, 2)]


def test_attachment_digest_ignores_order(spark):
    kind = "a array<struct<url:string,sha256:string,status:string,text:string>>"
    one, two = ("u", "s", "parsed", "t"), ("v", None, "failed", "")
    df = spark.createDataFrame([([one, two],), ([two, one],), ([one],), ([],), (None,)], kind)
    d = [r[0] for r in df.select(merge.attachment_digest(F.col("a"))).collect()]
    assert d[0] == d[1] and d[3] == d[4] and len(set(d)) == 3


def test_admission_stops_at_the_first_rejection(spark):
    df = spark.createDataFrame([("m", i, Decimal("0.2") if i != 5 else Decimal("99")) for i in range(10)] + [("k", i, Decimal("0.2")) for i in range(300)], "m string, n int, r decimal(12,4)")
    out = budget.admitted(df, F.col("m"), [F.col("n")], F.col("r"), "50", 300).groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.max("reserved").alias("r"))
    # exact amounts: 250 calls of 0.2 fit into 50
    assert rows(out) == [("k", 250, Decimal("50.0000")), ("m", 5, Decimal("1.0000"))]


def test_quality(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "", 3), (3, "y", 1)], "id int, t string, n int")
    assert rows(quality.violations(df, "id", {"empty": F.col("t") == "", "large": F.col("n") > 2})) == [("empty", 2), ("large", 2)]
    assert quality.require(df.where("id > 5"), "none").collect() == []
    with pytest.raises(Exception, match="duplicates"):
        quality.require(df, "duplicates").collect()


def test_relational(spark):
    e = spark.createDataFrame([("u", t) for t in (0, 10, 25, 25, 60)], "k string, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    assert [r["session"] for r in relational.sessions(e, ["k"], "ts", 15).orderBy("ts").collect()] == [1, 1, 1, 1, 2]
    points, spans = spark.createDataFrame([(0,), (9,), (10,), (250,)], "p long"), spark.createDataFrame([(0, 10, "a"), (5, 300, "b"), (7, 7, "none")], "lo long, hi long, n string")
    assert rows(relational.interval_join(points, spans, "p", "lo", "hi", 50).select("p", "n")) == [(0, "a"), (9, "a"), (9, "b"), (10, "b"), (250, "b")]
    left = spark.createDataFrame([("hot", i) for i in range(100)] + [("cold", 1)], "k string, v int")
    right = spark.createDataFrame([("hot", "h"), ("cold", "c")], "k string, w string")
    assert rows(relational.salted_join(left, right, "k", 8)) == rows(left.join(right, "k"))
    assert rows(relational.salted_counts(left, ["k"])) == [("cold", 1), ("hot", 100)]


def test_attachment_digests_are_those_of_the_records(spark):
    import hashlib
    import json

    files = [[("u2", "s2", "parsed", 'a "quoted"\ttext'), ("u1", "s1", "failed", None)], [("u", None, "pending", "文")], [], None]
    df = spark.createDataFrame(list(enumerate(files)), "i int, f array<struct<url:string,sha256:string,status:string,text:string>>")
    expected = [hashlib.sha256(json.dumps(sorted([u, s, k, t or ""] for u, s, k, t in own or []), ensure_ascii=False).encode()).hexdigest() for own in files]
    assert [r[1] for r in rows(df.select("i", merge.attachment_digest(F.col("f"))))] == expected


def test_changes_of_what_was_read_from_files(spark):
    log = [(1, "c", "a1", "k1", False), (2, "c", "a2", "k1", False), (3, "c", "a3", "k2", False), (4, "d", "a4", "k2", False), (5, None, None, None, True), (6, "d", "a4", "k2", False)]
    df = spark.createDataFrame([("p", *r) for r in log], "id string, n int, c string, a string, k string, bad boolean")
    out = merge.version_history(df, "id", [F.col("n")], F.col("bad"), "c", "a", files="k")
    assert [r[1:] for r in rows(out.select("n", "event", "change_type"))] == [("new", None), ("updated", "parser_output"), ("updated", "attachments"), ("updated", "content"), ("failed", None), ("unchanged", None)]


def test_tasks_of_a_run(spark):
    from loomwright.operators import readings, tasks

    t = spark.createDataFrame([(i,) for i in range(5)], "n int")
    assert rows(tasks.batch(t, [F.desc("n")], 2)) == [(3,), (4,)] and tasks.batch(t, [F.desc("n")], 0).count() == 5
    entries = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    stored = spark.createDataFrame([("a", None), ("b", "down")], "k string, e string")
    assert rows(tasks.backfill_open(entries, stored, entries, "k", F.col("e").isNotNull())) == [("b",), ("c",)]
    health = merge.health_after(spark.createDataFrame([("a", True, False), ("b", True, True), ("c", False, False)], "c string, ok boolean, pending boolean"), spark.createDataFrame([("b", "t0", 2), ("c", "t0", 2)], "c string, last_success_at string, consecutive_failures int"), "c", "r", "t1")
    assert rows(health) == [("a", "r", "t1", 0, "ok"), ("b", "r", "t0", 0, "pending"), ("c", "r", "t0", 3, "degraded")]
    with pytest.raises(Exception, match="missing parent: c"):
        quality.referential(entries, stored, "k", "missing parent").collect()
    with pytest.raises(ValueError, match="required"):
        quality.required(t, ["n", "x"])
    # a current reading counts only under the record's own fingerprint
    p = spark.createDataFrame([("i", 1, "储能", "", "complete", "h", "g", "2026-01-01T00:00:00+00:00", "2026-01-01", "u", ["c"])], "id string, record_id long, title string, content_text string, content_status string, content_hash string, attachments_hash string, last_checked_at string, publish_date string, url string, column_ids array<string>")
    hashed = readings.with_fingerprint(p, "r").first()["input_hash"]
    a = spark.createDataFrame([("i", 1, hashed, "complete", "直接相关", "待核查", ([],), None), ("i", 2, "old", "irrelevant", "无关", None, None, None)], "id string, analysis_no long, input_hash string, status string, relevance string, review_status string, interpretation struct<topics:array<string>>, analyzed_at string")
    index = readings.reading_index(p, a, a.select("id").limit(0), "r")
    assert rows(index.select("id", "canonical_id", "status", "visible")) == [("i", "i", "complete", True)] and rows(readings.category_counts(index)) == [(1, 0, 0, 0, 1)]
    assert rows(readings.reading_index(p, a, a.select("id").limit(0), "s").select("status", "visible", "relevance")) == [("pending", False, None)]
