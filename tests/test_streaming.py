from pyspark.sql import functions as F

from conftest import rows
from loomwright.streaming import upsert

S = "k string, at long, v string, bad boolean"
BATCHES = [[("a", 1, "x", True), ("b", 5, "x", False)], [("a", 3, "z", True), ("a", 2, "y", False)], [("b", 4, "late", True)]]


def parts(spark, path, batches=BATCHES):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, S).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return upsert.read_stream(spark, f"{path}/in", files_per_trigger=1)


def test_upsert_keeps_the_newest_over_late_rows(spark, tmp_path):
    path = f"file://{tmp_path}"
    assert rows(upsert.run_upsert(parts(spark, path), ["k"], ["at"], path).select("k", "at", "v")) == [("a", 3, "z"), ("b", 5, "x")]
    # a second run goes on where the first ended
    more = parts(spark, path, [[("c", 1, "new", False), ("a", 9, "w", False)]])
    assert rows(upsert.run_upsert(more, ["k"], ["at"], path).select("k", "v")) == [("a", "w"), ("b", "x"), ("c", "new")]


def test_a_batch_delivered_again_changes_nothing(spark, tmp_path):
    target = upsert.Upsert(spark, ["k"], ["at"], f"file://{tmp_path}/t")
    one, two = (spark.createDataFrame(b, S) for b in BATCHES[:2])
    target.apply(one, 0)
    target.apply(two, 1)
    before = rows(target.table())
    target.apply(two, 1)
    assert rows(target.table()) == before and len(target.manifests()) == 2


def test_windows_and_states(spark, tmp_path):
    path = f"file://{tmp_path}"
    stream = parts(spark, path).withColumn("ts", F.timestamp_seconds("at"))
    out = upsert.run_windows(stream, "ts", ["k"], "2 seconds", path=f"{path}/w")
    batch = spark.createDataFrame([r for b in BATCHES for r in b], S).groupBy("k", (F.floor(F.col("at") / 2) * 2).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    assert rows(out.select("k", F.unix_timestamp("start").alias("s"), "n")) == rows(batch.select("k", "s", "n"))
    states = upsert.run_states(upsert.read_stream(spark, f"{path}/in", 99), "k", "at", "bad", f"{path}/s")
    assert rows(states) == [("a", 1, 2), ("b", 0, 5)]
    # however the rows are cut into batches, late and repeated ones included
    again = parts(spark, f"{path}/again", [*BATCHES, BATCHES[1], [("a", 1, "x", True), ("b", 9, "y", True)]])
    assert rows(upsert.run_states(again, "k", "at", "bad", f"{path}/s2")) == [("a", 1, 2), ("b", 1, 5)]


def test_upsert_rewrites_touched_parts_only(spark, tmp_path):
    target = upsert.Upsert(spark, ["k"], ["at"], f"file://{tmp_path}/t", parts=8)
    target.apply(spark.createDataFrame([(str(i), 1, "x", False) for i in range(40)], S), 0)
    first = target._named(target.manifests()[-1])
    target.apply(spark.createDataFrame([("3", 2, "y", False)], S), 1)
    second = target._named(target.manifests()[-1])
    assert len(first) == 8 and sum(first[p] != second[p] for p in first) == 1 and target.table().count() == 40
    target.apply(spark.createDataFrame([("3", 3, "z", False)], S), 2)
    # the folder that only an old manifest named is gone
    assert len(target.manifests()) == 2 and len(target._folders("data/000000000000")) == 8 and rows(target.table().where("k = '3'").select("v")) == [("z",)]
