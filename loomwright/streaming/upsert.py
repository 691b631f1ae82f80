"""Streaming forms of the stateful steps: keyed upserts, event-time windows and failure counters."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import scratch


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A Parquet table as a stream; its schema is read from the files, never inferred from values."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        # a file source watches folders: the file's own, narrowed to its name
        return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())
    return reader.parquet(path)


class Upsert:
    """A keyed table in parts, fed by micro-batches; a batch rewrites only the parts its keys fall into.

    The table is a manifest: the folder of every part.  A batch writes new folders for its parts, then
    publishes a manifest under its own number, which is what readers follow; so readers see a batch
    whole or not at all.  A batch delivered again after a failure begins from the manifest before it and
    replaces what it wrote: nothing is applied twice.  The newest row by ``order`` wins, also over late
    rows.  ``vacuum`` deletes folders that neither of the last ``keep`` manifests names.
    """

    def __init__(self, spark: SparkSession, key: list[str], order: list[str], path: str, parts: int = 16, keep: int = 2):
        self.spark, self.key, self.order, self.path, self.parts, self.keep = spark, key, order, path, parts, keep

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _folders(self, kind: str) -> list[str]:
        fs, root = self._fs(f"{self.path}/{kind}")
        return sorted(str(s.getPath()) for s in fs.listStatus(root)) if fs.exists(root) else []

    def manifests(self) -> list[str]:
        """Complete manifests, the oldest first."""
        return [m for m in self._folders("manifests") if self._fs(m)[0].exists(self._fs(f"{m}/_SUCCESS")[1])]

    def newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.key]
        best = F.max(F.struct(*self.order, *[c for c in rest if c not in self.order])).alias("_b")
        return rows.groupBy(*self.key).agg(best).select(*self.key, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*rows.columns)

    def _named(self, manifest: str) -> dict[int, str]:
        """Part to folder; a manifest has one short row for each part."""
        return {r["part"]: r["folder"] for r in self.spark.read.schema("part int, folder string").parquet(manifest).collect()}

    def apply(self, batch: DataFrame, number: int) -> None:
        """``foreachBatch``: merges one micro-batch into the last table before it."""
        before = [m for m in self.manifests() if int(m.rsplit("/", 1)[1]) < number]
        old = self._named(before[-1]) if before else {}
        part = F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")
        touched = sorted(r["part"] for r in batch.select(part.alias("part")).distinct().collect())
        kept = [old[p] for p in touched if p in old]
        rows = batch.unionByName(self.spark.read.schema(batch.schema).parquet(*kept)) if kept else batch
        folder = f"{self.path}/data/{number:012d}"
        self.newest(rows).withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(folder)
        named = old | {p: f"{folder}/part={p}" for p in touched}
        self.spark.createDataFrame(sorted(named.items()), "part int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{number:012d}")
        self.vacuum()

    def vacuum(self) -> None:
        """Deletes manifests before the last ``keep``, and part folders that no kept one names."""
        manifests = self.manifests()
        named = {f for m in manifests[-self.keep :] for f in self._named(m).values()}
        newest = manifests[-1].rsplit("/", 1)[1] if manifests else ""
        for folder in self._folders("data"):
            for own in self._folders(f"data/{folder.rsplit('/', 1)[1]}"):
                name = own.rsplit("/", 1)[1]
                if name.startswith("part=") and folder.rsplit("/", 1)[1] <= newest and not any(n.endswith(f"{folder.rsplit('/', 1)[1]}/{name}") for n in named):
                    fs, target = self._fs(own)
                    fs.delete(target, True)
        for manifest in manifests[: -self.keep]:
            fs, target = self._fs(manifest)
            fs.delete(target, True)

    def table(self) -> DataFrame:
        """The table as the last complete manifest has it."""
        return self.spark.read.parquet(*self._named(self.manifests()[-1]).values())


def run_upsert(stream: DataFrame, key: list[str], order: list[str], path: str | None = None) -> DataFrame:
    """Runs the stream over all that is there and returns the table."""
    spark = stream.sparkSession
    path = path or scratch(spark, "upsert")
    target = Upsert(spark, key, order, f"{path}/table")
    query = stream.writeStream.foreachBatch(target.apply).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return target.table()


def run_windows(stream: DataFrame, at: str, by: list[str], width: str, late: str = "1 day", path: str | None = None) -> DataFrame:
    """(start, by, n): event-time counts under a watermark, after the stream has run over all that is there.

    In update mode every batch emits its changed windows; the last emission of each counts.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, "windows")
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    counts = timed.groupBy(F.window("_at", width)["start"].alias("start"), *by).agg(F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch-{number:012d}")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    emitted = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/out")
    return emitted.groupBy("start", *by).agg(F.max_by("n", "batch").alias("n"))


def failure_states(stream: DataFrame, key: str, at: str, failed: str) -> DataFrame:
    """(key, failures, last_success): custom state of each key, emitted whenever rows of it arrive.

    The state is the latest success by ``at`` and the failures after it, each by its ``at``, so it is
    the same however rows are cut into batches: late rows count at their place and rows delivered twice
    count once.  It holds one number for every failure since the last success.
    """
    kind, place = stream.schema[key].dataType.simpleString(), stream.schema[at].dataType.simpleString()

    def advance(keys, frames: Iterator, state):
        import pandas as pd

        success, after = state.get if state.exists else (None, [])
        open_failures = set(after)
        for frame in frames:
            good = frame.loc[~frame[failed], at]
            if len(good):
                newest = good.max().item()
                success = newest if success is None else max(success, newest)
            open_failures.update(frame.loc[frame[failed], at].tolist())
            open_failures = {f for f in open_failures if success is None or f > success}
        state.update((success, sorted(open_failures)))
        yield pd.DataFrame({key: [keys[0]], "failures": [len(open_failures)], "last_success": [success]}).astype({"last_success": object})

    return stream.groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, failures long, last_success {place}", f"last_success {place}, failures array<{place}>", "update", "NoTimeout")


def run_states(stream: DataFrame, key: str, at: str, failed: str, path: str | None = None) -> DataFrame:
    """The last state of each key after the stream has run over all that is there."""
    spark = stream.sparkSession
    path = path or scratch(spark, "states")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch-{number:012d}")

    states = failure_states(stream, key, at, failed)
    states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint-{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()
    emitted = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/out")
    best = F.max_by(F.struct("failures", "last_success"), "batch").alias("s")
    return emitted.groupBy(key).agg(best).select(key, "s.failures", "s.last_success")
