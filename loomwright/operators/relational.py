"""Relational operations beyond the record store: stars, ranks, sessions and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_per_key(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of every key; Spark limits each task's rows before the shuffle."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("n") <= most)


def sessions(rows: DataFrame, by: list[str], at: str, gap_seconds: int) -> DataFrame:
    """Rows with ``session``, numbered from 1 in each key: a new one begins after a gap longer than ``gap_seconds``."""
    over = W.partitionBy(*by).orderBy(at)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    far = (seconds - F.lag(seconds).over(over)) > gap_seconds
    marked = rows.withColumn("_new", F.when(far.isNull() | far, 1).otherwise(0))
    return marked.withColumn("session", F.sum("_new").over(over.rangeBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, begin: str, end: str, width: int) -> DataFrame:
    """Points joined with the intervals [begin, end) that hold them (integers), by cells of ``width``.

    An interval is laid out over the cells it touches and a point falls into one, so the join is an
    equality of cells with the bounds as residue; a long interval costs (length / width) rows.
    """
    cells = intervals.where(F.col(end) > F.col(begin)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor((F.col(end) - 1) / width))))
    placed = points.withColumn("_cell", F.floor(F.col(at) / width))
    return placed.join(cells, "_cell").where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("_cell")


def salted_counts(rows: DataFrame, by: list[str], salts: int = 16) -> DataFrame:
    """(by, n, distinct values apart): counts of keys of which one may hold most rows.

    Counting is combined before the shuffle anyway; the salt spreads what is not (see ``salted_join``).
    """
    salted = rows.groupBy(*by, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("_salt")).agg(F.count(F.lit(1)).alias("n"))
    return salted.groupBy(*by).agg(F.sum("n").alias("n"))


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """A join on a key of which the left side holds very many rows: left rows are spread over salts, right rows repeated for each."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c, kind in left.dtypes if not kind.startswith("map")]), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)])))
    return a.join(b, [key, "_salt"], how).drop("_salt")


def exact_percentile(rows: DataFrame, by: list[str], value: str, share: float, name: str, cells: int = 4096) -> DataFrame:
    """(by, name): the percentile of each key by linear interpolation, exact, in two passes.

    The first pass counts the values of every key in ``cells`` equal cells of its range, combined before
    the shuffle; the second orders only the rows of the one or two cells that hold the wanted ranks.
    Nulls do not count; a key of nulls alone gives null.
    """
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    bounds = known.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_n"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    span = F.col("_high") - F.col("_low")
    cell = F.when(span > 0, F.least(F.lit(cells - 1), F.floor((F.col("_v") - F.col("_low")) / span * cells))).otherwise(0).cast("int")
    placed = known.alias("r").join(bounds.alias("b"), same).select(*[F.col(f"r.{c}").alias(c) for c in by], "_v", "_n", cell.alias("_cell"))
    counts = placed.groupBy(*by, "_n", "_cell").agg(F.count(F.lit(1)).alias("_k"))
    until = F.sum("_k").over(W.partitionBy(*by).orderBy("_cell"))
    rank = (F.col("_n") - 1) * F.lit(share)
    wanted = counts.withColumn("_before", until - F.col("_k")).where((F.floor(rank) < F.col("_before") + F.col("_k")) & (F.ceil(rank) >= F.col("_before"))).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_cell").alias("_c"), "_before")
    inside = placed.join(wanted, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("_cell") == F.col("_c")])
    ranked = inside.withColumn("_at", F.col("_before") + F.row_number().over(W.partitionBy(*by, "_cell").orderBy("_v")) - 1)
    ends = ranked.where((F.col("_at") == F.floor(rank)) | (F.col("_at") == F.ceil(rank))).groupBy(*by).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.first(rank - F.floor(rank)).alias("_part"))
    keys = rows.select(*by).distinct().alias("r")
    found = keys.join(ends.alias("b"), same, "left")
    return found.select(*[F.col(f"r.{c}").alias(c) for c in by], (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias(name))


def nearest_vectors(rows: DataFrame, queries: DataFrame, key: str, vector: str, most: int, block: int = 4096) -> DataFrame:
    """(query_id, key, similarity, n): for each query the ``most`` rows of largest cosine similarity, itself left out; ties by key.

    The queries are a stated set: they are counted, and go to the executors in blocks of ``block``
    vectors.  Every batch of rows is one matrix product and passes on its own best ``most`` rows of each
    query, so what is shuffled is a few rows for each batch and query.  Vectors of length 0 match nothing.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    total = queries.count()
    blocks = max(1, -(-total // block))
    read = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    parts = None
    for number in range(blocks):
        own = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == number).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL").collect()
        shared = spark.sparkContext.broadcast(([r["k"] for r in own], [r["v"] for r in own]))

        def run(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            ids, vectors = shared.value
            if not ids:
                return
            unit = lambda m: m / np.where(norm := np.linalg.norm(m, axis=1, keepdims=True), norm, np.nan)
            asked, names = unit(np.array(vectors)), np.array(ids)
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.array(batch.column(0).to_pylist())
                scores = asked @ unit(np.array(batch.column(1).to_pylist())).T
                scores[(names[:, None] == keys[None, :]) | np.isnan(scores)] = -np.inf
                # rows in order of key, so that a stable sort settles ties
                order = np.argsort(keys, kind="stable")
                best = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :most]]
                at = np.repeat(np.arange(len(names)), best.shape[1])
                flat = best.ravel()
                keep = np.isfinite(scores[at, flat])
                out = names[at][keep].tolist(), keys[flat][keep].tolist(), scores[at, flat][keep]
                yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], batch.schema.field(0).type), pa.array(out[2], pa.float64())], names=["query_id", "k", "similarity"])

        part = read.mapInArrow(run, f"query_id {kind}, k {kind}, similarity double")
        parts = part if parts is None else parts.unionByName(part)
    return top_per_key(parts, ["query_id"], [F.desc("similarity"), F.asc("k")], most).withColumnRenamed("k", key)
