"""Running sums and last values along ordered keys of any size.

A window over a key runs in one task, so a key with a third of all rows would too.  Here a key's rows
are cut into chunks that follow its order (days of a log, ranges of an id): the window runs inside
each chunk, one row for each chunk carries its total on, and the carried values are joined back.
The chunk rows of a key are few and narrow, and the rows are shuffled once, by key and chunk, for
both the window and the join.

``order`` are columns in ascending order, nulls first; ``chunk`` must not decrease along them (null
is the lowest).  Without a chunk it is the plain window.  Ties in the order need a further column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _ascending(order: list[Column]) -> list[Column]:
    return [c.asc_nulls_first() for c in order]


def _carried(rows: DataFrame, by: list[str], carried: DataFrame) -> DataFrame:
    """Rows with the carried columns of their key and chunk; null keys are keys."""
    keys = [*by, "_chunk"]
    right = carried.select(*[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)], *[c for c in carried.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{i}"))
    return rows.join(right, same, "left").drop(*[f"_r_{i}" for i in range(len(keys))])


def running_sums(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], chunk: Column | None = None) -> DataFrame:
    """The rows with sums from the key's first row up to each row; nulls count as 0."""
    placed = rows.withColumn("_chunk", chunk if chunk is not None else F.lit(0)).withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    inside = W.partitionBy(*by, "_chunk").orderBy(*_ascending(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = placed.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in sums})
    if chunk is not None:
        totals = placed.groupBy(*by, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
        before = W.partitionBy(*by).orderBy(F.col("_chunk").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
        carried = totals.select(*by, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums])
        local = _carried(local, by, carried).withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in sums}).drop(*[f"_c_{n}" for n in sums])
    return local.drop("_chunk", *[f"_v_{n}" for n in sums])


def last_values(rows: DataFrame, by: list[str], order: list[Column], values: dict[str, Column], chunk: Column | None = None, inclusive: bool = False) -> DataFrame:
    """The rows with the key's last non-null value before each row (or up to it)."""
    placed = rows.withColumn("_chunk", chunk if chunk is not None else F.lit(0)).withColumns({f"_v_{n}": c for n, c in values.items()})
    inside = W.partitionBy(*by, "_chunk").orderBy(*_ascending(order)).rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
    local = placed.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values})
    if chunk is not None:
        place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
        lasts = placed.groupBy(*by, "_chunk").agg(*[F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(place.alias("o"), F.col(f"_v_{n}").alias("v")))).alias(f"_t_{n}") for n in values])
        before = W.partitionBy(*by).orderBy(F.col("_chunk").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
        carried = lasts.select(*by, "_chunk", *[F.last(f"_t_{n}", ignorenulls=True).over(before)["v"].alias(f"_c_{n}") for n in values])
        local = _carried(local, by, carried).withColumns({n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in values}).drop(*[f"_c_{n}" for n in values])
    return local.drop("_chunk", *[f"_v_{n}" for n in values])


def up_to_first(rows: DataFrame, by: list[str], order: list[Column], hit: Column, inclusive: bool) -> DataFrame:
    """Rows before the key's first row that is hit (with it, if inclusive); all rows of a key without one. An aggregation and a join, no window."""
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    placed = rows.withColumn("_place", place)
    stops = placed.where(F.coalesce(hit, F.lit(False))).groupBy(*[F.col(k).alias(f"_r_{i}") for i, k in enumerate(by)]).agg(F.min("_place").alias("_stop"))
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{i}"))
    kept = (F.col("_place") <= F.col("_stop")) if inclusive else (F.col("_place") < F.col("_stop"))
    return placed.join(stops, same, "left").where(F.col("_stop").isNull() | kept).drop("_place", "_stop", *[f"_r_{i}" for i in range(len(by))])
