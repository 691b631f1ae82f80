"""Processing only what is new or changed since the last success.

A table is cut into partitions by a hash of its key.  The fingerprint of a partition is its row
count and the sums of both halves of a 64-bit hash of each row: additive, so it is combined before
the shuffle, does not depend on order, and grows by the rows that arrive.  ``refresh`` recomputes
exactly the partitions whose fingerprint is not the one stored with the last success, replaces them
through dynamic partition overwrite, and stores the new fingerprints last.  A run that dies in
between leaves the old fingerprints, so the next run does the same partitions again and replaces
what was written: nothing is skipped, nothing stays twice.

``changes_by_run`` answers another question, what each of many past runs had to take, in one pass over
the log: a window over each key's runs.  A run whose partitions are recomputed by ``refresh`` finds the
same keys (tested); replaying every run that way would read the log once for each.

Defined results: a null key is a key of its own; null values compare equal to null; rows delivered
twice change nothing; failed rows never count; without a succeeded run there is no case; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of the source that one partition is meant to hold when a table is first built.
PARTITION_ROWS = 1_000_000
#: Partitions of a small table.
LEAST_PARTITIONS = 64


def partition_of(key: Column, partitions: int) -> Column:
    """The partition of a key."""
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")


def partitions_for(rows: int) -> int:
    """How many partitions a table of so many source rows gets: a power of two, so that each holds about ``PARTITION_ROWS`` rows."""
    return max(LEAST_PARTITIONS, 1 << max(0, (-(-rows // PARTITION_ROWS) - 1).bit_length()))


def fingerprint_columns(columns: list[Column]) -> list[Column]:
    """Aggregates: rows, and the additive hash of their columns in two halves (no overflow below 2**31 rows a partition)."""
    h = F.xxhash64(*columns)
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")]


def fingerprints(df: DataFrame, key: str, columns: list[str], partitions: int) -> DataFrame:
    """(part, rows, high, low) of every partition that has rows."""
    return df.groupBy(partition_of(F.col(key), partitions).alias("part")).agg(*fingerprint_columns([F.col(c) for c in columns]))


def changed_partitions(new: DataFrame, old: DataFrame) -> DataFrame:
    """(part, gone): partitions whose fingerprint differs; gone where no row is left."""
    a, b = new.alias("a"), old.alias("b")
    same = (F.col("a.rows") == F.col("b.rows")) & (F.col("a.high") == F.col("b.high")) & (F.col("a.low") == F.col("b.low"))
    both = a.join(b, F.col("a.part") == F.col("b.part"), "full")
    return both.where(~F.coalesce(same, F.lit(False))).select(F.coalesce("a.part", "b.part").alias("part"), F.col("a.part").isNull().alias("gone"))


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, target, fs.exists(target)


def refresh(source: DataFrame, key: str, columns: list[str], compute: Callable[[DataFrame], DataFrame], path: str, partitions: int | None = None) -> DataFrame:
    """Brings the table at ``path`` up to date with ``source`` and returns (part, gone) of what was redone.

    compute: rows of some whole partitions to their result (one key's result may depend on that
    key's rows only).  The result is stored by partition below ``path/data``; ``path/done-*`` holds
    the fingerprints of each success, the latest one counts, and its name the number of partitions,
    which stays as it was when the table was built.
    """
    spark = source.sparkSession
    fs, root, there = _open(spark, path)
    of = lambda name: int(name.rsplit("/", 1)[1].split("-")[1])
    done = sorted((str(s.getPath()) for s in fs.listStatus(root) if s.getPath().getName().startswith("done-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))), key=of) if there else []
    if done:
        partitions = int(done[-1].rsplit("/", 1)[1].split("-")[2])
    elif partitions is None:
        partitions = partitions_for(source.count())
    new = fingerprints(source, key, columns, partitions)
    old = spark.read.parquet(done[-1]) if done else spark.createDataFrame([], new.schema)
    number = of(done[-1]) + 1 if done else 1
    mark = f"{path}/done-{number}-{partitions}-{uuid.uuid4().hex}"
    # the fingerprints are read once: what is recomputed and what is recorded must agree
    pending = f"{path}/pending-{uuid.uuid4().hex}"
    new.write.parquet(pending)
    new = spark.read.parquet(pending)
    changed = changed_partitions(new, old)
    redo = changed.where("NOT gone").select("part")
    rows = source.withColumn("_part", partition_of(F.col(key), partitions)).join(redo.withColumnRenamed("part", "_part"), "_part", "left_semi")
    result = compute(rows.drop("_part")).withColumn("part", partition_of(F.col(key), partitions))
    result.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/data")
    # partitions that lost all rows: one folder each
    for row in changed.where("gone").toLocalIterator():
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/part={row['part']}"), True)
    new.write.parquet(mark)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(pending), True)
    return changed_partitions(spark.read.parquet(mark), old)


def first_at_or_after(at: Column, cutoffs: list) -> Column:
    """1-based place of the first cutoff (ascending) that is not before ``at``; null after the last. A balanced tree of comparisons."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low + 1) if low < len(cutoffs) else F.lit(None).cast("int")
        middle = (low + high) // 2
        return F.when(at <= F.lit(cutoffs[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return F.when(at.isNotNull(), tree(0, len(cutoffs)))


def succeeded_runs(runs: DataFrame, kind: str) -> list[tuple[str, object]]:
    """(run_id, cutoff) of the succeeded runs in order.  The run log is small (one row a run); it is read to the driver."""
    rows = runs.where((F.col("kind") == kind) & (F.col("status") == "succeeded") & F.col("cutoff_at").isNotNull()).select("run_id", "cutoff_at", "started_at").collect()
    return [(r["run_id"], r["cutoff_at"]) for r in sorted(rows, key=lambda r: (r["cutoff_at"], str(r["started_at"]), r["run_id"]))]


def changes_by_run(checks: DataFrame, runs: list[tuple[str, object]], key: str, arrived: str, order: list[Column], state: list[str], counts: Column) -> DataFrame:
    """(run_id, key): keys whose state at a run differs from that at the run before, or is their first.

    The state of a key is that of its row with the largest ``order`` among the rows that count and
    arrived by the run's cutoff.  Rows are put to the first run that sees them and reduced to the
    best row of each key and run before they are shuffled, so a key with a third of all rows
    becomes one row for each run; the running best is then a window over a key's few runs.
    """
    spark = checks.sparkSession
    if not runs:
        return spark.createDataFrame([], "run_id string, id string").select("run_id", F.col("id").alias(key))
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c) for c in state])
    seen = checks.where(F.coalesce(counts, F.lit(True))).select(F.col(key).alias("key"), first_at_or_after(F.col(arrived), [c for _, c in runs]).alias("run"), at.alias("best"))
    best = seen.where("run IS NOT NULL").groupBy("key", "run").agg(F.max("best").alias("best"))
    history = W.partitionBy("key").orderBy("run")
    running = best.withColumn("now", F.max("best").over(history.rowsBetween(W.unboundedPreceding, W.currentRow)))
    values = F.struct(*[F.col(f"now.{c}").alias(c) for c in state])
    compared = running.select("key", "run", values.alias("state"), F.lag(values).over(history).alias("was"))
    names = F.element_at(F.array(*[F.lit(r) for r, _ in runs]), F.col("run"))
    return compared.where(F.col("was").isNull() | ~F.col("state").eqNullSafe(F.col("was"))).select(names.alias("run_id"), F.col("key").alias(key))


def latest_rows(rows: DataFrame, key: str, order: list[Column], columns: list[Column], counts: Column) -> DataFrame:
    """(key, columns) of each key's row with the largest ``order`` among the rows that count."""
    best = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *columns)
    return rows.where(F.coalesce(counts, F.lit(True))).groupBy(key).agg(F.max(best).alias("_best")).select(key, "_best.*").drop(*[f"o{i}" for i in range(len(order))])
