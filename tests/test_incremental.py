import datetime
import random

from pyspark.sql import functions as F

from conftest import rows
from loomwright.operators import incremental as inc

S = "check_id long, id string, arrived_at timestamp_ntz, at int, content_status string, h string, a string"
T0 = datetime.datetime(2026, 1, 1)
STATE = ["h", "a"]


def log(seed, n=400, ids=12):
    r = random.Random(seed)
    out = []
    for i in range(n):
        failed = r.random() < 0.2
        key = "hot" if r.random() < 0.3 else f"id{r.randrange(ids)}"
        row = (i, key, T0 + datetime.timedelta(hours=r.randrange(200)), r.randrange(100), "failed" if failed else r.choice(["complete", None]), r.choice(["x", "y", None]), r.choice(["p", None]))
        out.append(row)
        if r.random() < 0.1:
            out.append((row[0], row[1], row[2] + datetime.timedelta(hours=r.randrange(50)), *row[3:]))
    return out


def brute(data, runs):
    found, before = [], {}
    for run, cutoff in runs:
        now = {}
        for c in data:
            if c[2] <= cutoff and c[4] != "failed" and (c[1] not in now or (c[3], c[0]) > now[c[1]][0]):
                now[c[1]] = ((c[3], c[0]), (c[5], c[6]))
        state = {k: v for k, (_, v) in now.items()}
        found += [(run, k) for k, v in state.items() if k not in before or before[k] != v]
        before = state
    return sorted(found)


def changes(df, runs):
    return rows(inc.changes_by_run(df, runs, "id", "arrived_at", [F.col("at"), F.col("check_id")], STATE, F.coalesce(F.col("content_status"), F.lit("")) != "failed"))


def test_changes_equal_a_replay(spark):
    runs = [(f"r{i}", T0 + datetime.timedelta(hours=h)) for i, h in enumerate((0, 20, 21, 80, 80, 199, 400))]
    for seed in range(3):
        data = log(seed)
        assert changes(spark.createDataFrame(data, S), runs) == brute(data, runs)
    assert changes(spark.createDataFrame([], S), runs) == [] and changes(spark.createDataFrame(log(1), S), []) == []


def test_runs_in_order(spark):
    kind = "run_id string, kind string, cutoff_at timestamp_ntz, started_at timestamp_ntz, status string"
    at = lambda h: T0 + datetime.timedelta(hours=h)
    df = spark.createDataFrame([("b", "collect", at(5), at(5), "succeeded"), ("a", "collect", at(1), at(1), "failed"), ("a", "collect", at(2), at(2), "succeeded"), ("c", "analyse", at(1), at(1), "succeeded"), ("d", "collect", at(9), at(9), "pending")], kind)
    assert [r for r, _ in inc.succeeded_runs(df, "collect")] == ["a", "b"]


def count(rows_):
    return rows_.groupBy("k").agg(F.sum("v").alias("total"))


def table(spark, data):
    return spark.createDataFrame(data, "k string, v int")


def test_refresh_redoes_changed_partitions_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    data = [(f"k{i}", i) for i in range(200)]
    first = inc.refresh(table(spark, data), "k", ["k", "v"], count, path, 16)
    assert first.count() == 16
    assert inc.refresh(table(spark, data[::-1]), "k", ["k", "v"], count, path, 16).count() == 0  # another order is no change
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t/data").rglob("*.parquet")}
    changed = [(k, v + 1 if k == "k7" else v) for k, v in data] + [("k8", 0)]
    redone = {r["part"] for r in inc.refresh(table(spark, changed), "k", ["k", "v"], count, path, 16).collect()}
    parts = {r["k"]: r["p"] for r in table(spark, data).select("k", inc.partition_of(F.col("k"), 16).alias("p")).collect()}
    assert redone == {parts["k7"], parts["k8"]}
    kept = {p for p, t in files.items() if p.exists() and p.stat().st_mtime_ns == t}
    assert {int(p.parent.name.split("=")[1]) for p in kept} == set(range(16)) - redone
    assert rows(spark.read.parquet(f"{path}/data").select("k", "total")) == sorted(count(table(spark, changed)).collect())


def test_refresh_after_a_failure(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    data = [(f"k{i}", i) for i in range(50)]
    inc.refresh(table(spark, data), "k", ["k", "v"], count, path, 4)

    def dies(rows_):
        return count(rows_).withColumn("total", F.when(F.assert_true(F.lit(False), F.lit("died")).isNull(), F.col("total")))

    changed = [*data, ("k1", 5), ("new", 1)]
    try:
        inc.refresh(table(spark, changed), "k", ["k", "v"], dies, path, 4).collect()
        raise RuntimeError("should have failed")
    except Exception as problem:
        assert "should have failed" not in str(problem)
    assert rows(spark.read.parquet(f"{path}/data").select("k", "total")) == sorted((k, v) for k, v in data)
    assert inc.refresh(table(spark, changed), "k", ["k", "v"], count, path, 4).count() >= 1
    assert rows(spark.read.parquet(f"{path}/data").select("k", "total")) == sorted(tuple(r) for r in count(table(spark, changed)).collect())


def test_refresh_drops_emptied_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    inc.refresh(table(spark, [("a", 1), ("b", 2), ("c", 3)]), "k", ["k", "v"], count, path, 64)
    out = inc.refresh(table(spark, [("a", 1)]), "k", ["k", "v"], count, path, 64).collect()
    assert {r["gone"] for r in out} == {True} and rows(spark.read.parquet(f"{path}/data").select("k", "total")) == [("a", 1)]


def test_fingerprints_count_repeated_rows(spark):
    a = inc.fingerprints(table(spark, [("a", 1), ("a", 1)]), "k", ["k", "v"], 4)
    b = inc.fingerprints(table(spark, [("a", 1)]), "k", ["k", "v"], 4)
    assert inc.changed_partitions(a, b).count() == 1 and inc.changed_partitions(a, a).count() == 0


def test_partitions_follow_the_rows():
    assert [inc.partitions_for(n) for n in (0, 64_000_000, 64_000_001, 10**12)] == [64, 64, 128, 1 << 20]


def test_runs_by_refresh_find_the_same_keys(spark, tmp_path):
    """Recomputing changed partitions run by run gives the cases that the one pass over the log gives."""
    import random

    rng = random.Random(3)
    log = [(f"k{rng.randint(0, 9)}", rng.randint(1, 30), rng.randint(1, 40), rng.choice("ab") if rng.random() > 0.1 else None, i) for i in range(60)]
    df = spark.createDataFrame([*log, *log[:9]], "k string, arrived int, at int, v string, n int")
    runs = [("r1", 8), ("r2", 17), ("r3", 25)]
    order = [F.col("at"), F.col("n")]
    once = set(rows(inc.changes_by_run(df, runs, "k", "arrived", order, ["v"], F.lit(True))))
    path, found = f"file://{tmp_path}/state", set()
    for name, cutoff in runs:
        before = {r["k"]: r["v"] for r in spark.read.parquet(f"{path}/data").collect()} if name != "r1" else {}
        inc.refresh(df.where(F.col("arrived") <= cutoff).dropDuplicates(["n"]), "k", ["n", "v"], lambda part: inc.latest_rows(part, "k", order, [F.col("v")], F.lit(True)), path, 8)
        after = {r["k"]: r["v"] for r in spark.read.parquet(f"{path}/data").collect()}
        found |= {(name, k) for k, v in after.items() if k not in before or before[k] != v}
    assert found == once
