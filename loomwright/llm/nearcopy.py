"""Records whose texts share most of their character windows, by generalised pigeonhole.

Each record becomes a sketch of bits: some independent hashes of its windows, each with the least
value at or after a number of even places (``shape_of``).  The bits of one such value agree or disagree
together, so they are grouped into one part: part ``i`` holds the values of all hashes at place
``i``.  A part's threshold says how many of its values may differ: none (one key), one (a key for
each value left out), or -1, which skips the part.  Two records are candidates if some part differs
by no more than its threshold.

Thresholds are unequal.  ``allocate`` chooses them by dynamic programming: least estimated work
(candidates and keys) such that a pair of the least wanted similarity is missed in all parts with a
probability of at most ``MISS``; ``planned`` takes the number of values a part holds that makes this
least work smallest.  Candidates of each part and threshold are estimated from the
pairs among ``ESTIMATE_RECORDS`` records picked by hash; that bound concerns the estimate alone,
every record is indexed and probed.

Candidates are verified three times: while the index is probed, by 256 bits that travel with each
key; by the share of equal sketch bytes (both bounds lie so far from the wanted similarity that a
pair above it fails with a probability below 1e-4); then exactly on the windows of both texts.  Equal texts form
one class beforehand, so copies meet neither in the index nor in verification; class pairs are
expanded to records last, group by group of (class, id), never within one id.

Chance candidates grow with the square of the records, so what is written for each of them decides the
disk.  Only the two rows of a candidate that passes the bits are written.  The index is probed
``ROUND_KEYS`` keys of each record at a time, and candidates meet their sketch bytes and their texts in
slices of ``SLICE_PAIRS`` for each record; shuffle files of a round or slice are deleted when it is
written (``freeing``).  All rounds and slices are done: they bound what lies on disk at one time, not
what is compared.

A key with more than ``HOT_KEY`` rows is cut into blocks of rows, and pairs of blocks meet, so that no
task compares more than ``HOT_KEY`` rows with as many.

These bounds take the places of a sketch as independent, which they are not where a text has few
distinct windows (repetitive text).  Pairs with a text of fewer than ``PART_WINDOWS`` for each part take an
exact way instead: sets that overlap enough share a window among the first of each in any one order.  The
order takes windows that are common among the estimate's records last; it sets cost, not results.  As
such pairs can be many, ``planned`` counts them as work of the width that needs them.

Defined results: null or short texts match nothing; a null title counts as ''; rows without an id
pair with nothing; ties at the
threshold match; repeated rows of other ids are pairs; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import materialise, no_white

WINDOW = 5
SIMILARITY = 0.6
LEAST_CHARS = 300
#: Numbers of values a part may hold.
WIDTHS = (4, 5)
#: Rows of one key that are compared within one task.
HOT_KEY = 4000
#: Largest probability that a pair of exactly the wanted similarity is no candidate.
MISS = 1e-3
ESTIMATE_RECORDS = 4000
#: Work of one key (written, shuffled, sorted) in units of one candidate pair.
KEY_COST = 0.5

#: Travelling bits, the low bits of the kept bytes, as longs of 64.
BITS = 256
#: Standard deviations by which a pair of the wanted similarity may differ in more bits than it should (7e-6 fail).
BITS_SPREAD = 4.5
#: Keys of each record that are shuffled at one time.
ROUND_KEYS = 16
#: Candidates for each record that are laid beside their bytes or texts at one time.
SLICE_PAIRS = 2
#: Ids up to this number (16 MB) are broadcast after they were counted; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of a sketch that are kept for the second test; the low bits of all are the travelling bits.
BYTES = BITS
#: Windows for each part below which a text's pairs are found exactly.
PART_WINDOWS = 3
#: Texts of the estimate that hold a window, from which it counts as common.
COMMON = 5

MASK = (1 << 64) - 1


def shape_of(width: int, similarity: float = SIMILARITY, miss: float = MISS) -> tuple[int, int]:
    """(values of a part, parts): three tenths more parts than exact matching would need, so that some can be skipped."""
    needed = math.log(miss) / math.log(1 - similarity**width)
    return width, max(64, 16 * math.ceil(1.3 * needed / 16))


def windows(text: str):
    """Distinct hashes of all windows of the text, sorted."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points) - WINDOW + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h = points[:n].copy()
    for k in range(1, WINDOW):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += points[k : k + n]
    return np.unique(_mix(h))


def _mix(h):
    import numpy as np

    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def sketch(hashes, shape: tuple[int, int]):
    """Values of that shape: for each hash, the least value at or after each place."""
    import numpy as np

    width, parts = shape
    places = (np.arange(parts, dtype=np.uint64)) * np.uint64((1 << 64) // parts)
    out = np.empty(shape, dtype=np.uint64)
    for i in range(width):
        own = np.sort(_mix(hashes + np.uint64((0xD1B54A32D192ED03 * (i + 1)) & MASK)))
        out[i] = own[np.searchsorted(own, places) % len(own)]
    return out


def part_keys(values, out: int):
    """The key of every part, the value of hash ``out`` left out (-1: none); values may be of many sketches."""
    import numpy as np

    width, parts = values.shape[-2:]
    key = (np.arange(parts, dtype=np.uint64) * np.uint64(64) + np.uint64(out + 1)) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(width):
        if i != out:
            key = _mix(key ^ values[..., i, :])
    return key


def keys(values, thresholds):
    """The probe keys of a sketch under the thresholds, one for each way a part may match."""
    import numpy as np

    chosen = np.asarray(thresholds)
    found = [part_keys(values, -1)[chosen == 0]]
    if (chosen == 1).any():
        found += [part_keys(values, out)[chosen == 1] for out in range(values.shape[0])]
    return np.concatenate(found)


def hit_probability(threshold: int, width: int, similarity: float) -> float:
    """Probability that a part of a pair of that similarity differs by no more than the threshold."""
    return sum(math.comb(width, k) * (1 - similarity) ** k * similarity ** (width - k) for k in range(threshold + 1))


def allocate(candidates: list[dict[int, float]], width: int, records: float, similarity: float = SIMILARITY, miss: float = MISS) -> tuple[float, list[int]]:
    """(work, thresholds of the parts): least work whose joint miss probability stays within the bound.

    candidates: for each part, the estimated candidate pairs by threshold.  The dynamic program runs
    over parts and the logarithm of the miss probability reached so far, in steps of 0.01.
    """
    options = {-1: (0.0, 0.0)} | {t: (-math.log(1 - hit_probability(t, width, similarity)), float(width if t else 1)) for t in (0, 1)}
    goal = math.ceil(-math.log(miss) * 100)
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for own in candidates:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for reached, (work, chosen) in best.items():
            for t, (gain, count) in options.items():
                to = min(goal, reached + int(gain * 100))
                cost = work + (own[t] + count * records * KEY_COST if t >= 0 else 0.0)
                if to not in step or cost < step[to][0]:
                    step[to] = (cost, (*chosen, t))
        best = step
    work, chosen = best[max(best)]
    return work, list(chosen)


def estimated_candidates(sketches: list, records: int) -> list[dict[int, float]]:
    """Candidate pairs by part and threshold among all records, from the pairs among some."""
    import numpy as np

    n = len(sketches)
    values = np.stack(sketches)
    if n < 2:
        return [{0: 0.0, 1: 0.0} for _ in range(values.shape[-1])]
    scale = records * (records - 1) / (n * (n - 1))

    def pairs(out: int) -> list[float]:
        sizes = (np.unique(own, return_counts=True)[1].astype(float) for own in part_keys(values, out).T)
        return [float((size * (size - 1) / 2).sum()) for size in sizes]

    none, one = pairs(-1), [sum(own) for own in zip(*(pairs(out) for out in range(values.shape[-2])))]
    # no pair in a sample is little evidence: never estimate less than one
    return [{0: max(a, 1.0) * scale, 1: max(b, 1.0) * scale} for a, b in zip(none, one)]


def planned(texts: DataFrame, records: int, similarity: float) -> tuple[tuple[int, int], list[int]]:
    """(shape, thresholds) of least estimated work over the numbers of values a part may hold, from a bounded number of texts."""
    plans = []
    for width in WIDTHS:
        shape = shape_of(width, similarity)
        sizes, known = _sketches(texts, shape)
        if not known:
            return shape, [0] * shape[1]
        work, thresholds = allocate(estimated_candidates(known, records), width, records, similarity)
        # texts of few windows may meet any text that is not much longer
        few = PART_WINDOWS * shape[1]
        exact = sum(n < few for n in sizes) * sum(n <= few / similarity for n in sizes)
        plans.append((work + exact * (records / len(known)) ** 2, thresholds, shape))
    _, thresholds, shape = min(plans, key=lambda p: p[0])
    return shape, thresholds


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query are deleted when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def most_bits_apart(similarity: float) -> int:
    """Most of the travelling bits in which a pair may differ: bits of values that differ are equal by chance half the time."""
    differ = (1 - similarity) / 2
    return int(BITS * differ + BITS_SPREAD * math.sqrt(BITS * differ * (1 - differ)))


def _base(rows: DataFrame, row_id: str, group_id: str, title: str, body: str) -> DataFrame:
    """(row, own, text) of the rows long enough: title and body without white space."""
    read = rows.select(F.col(row_id).alias("row"), F.col(group_id).alias("own"), F.coalesce(no_white(F.col(title)), F.lit("")).alias("_t"), no_white(F.col(body)).alias("_b"))
    return read.where(F.length("_b") >= LEAST_CHARS).select("row", "own", F.concat("_t", "_b").alias("text"))


def _sketched(base: DataFrame, thresholds: list[int], shape: tuple[int, int]) -> DataFrame:
    """(row, own, digest, keys, bits0.., bytes, size) of every row; Python sees each text once."""
    row_type, own_type = base.schema["row"].dataType.simpleString(), base.schema["own"].dataType.simpleString()
    longs = [f"bits{i}" for i in range(BITS // 64)]

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        # spread over all hashes and places, as values at neighbouring places of one hash go together
        many = np.linspace(0, shape[0] * shape[1] - 1, BYTES).astype(int)
        for batch in batches:
            digests, probes, bits, small, sizes = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                own = windows(text)
                values = sketch(own, shape)
                sizes.append(len(own))
                digests.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
                probes.append(keys(values, thresholds).view(np.int64))
                kept = (values.ravel()[many] & np.uint64(255)).astype(np.uint8)
                bits.append(np.packbits(kept & 1).view(np.int64))
                small.append(kept.tobytes())
            count = len(probes[0]) if probes else 0
            flat = np.concatenate(probes) if probes else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(digests) + 1, dtype=np.int32) * count), pa.array(flat))
            apart = np.array(bits, dtype=np.int64).reshape(len(bits), len(longs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), lists, *(pa.array(x) for x in apart.T.copy()), pa.array(small, pa.binary()), pa.array(sizes, pa.int64())],
                names=["row", "own", "digest", "keys", *longs, "bytes", "size"],
            )

    return base.mapInArrow(run, f"row {row_type}, own {own_type}, digest binary, keys array<bigint>, {', '.join(f'{x} bigint' for x in longs)}, bytes binary, size bigint")


def _sketches(texts: DataFrame, shape: tuple[int, int]) -> tuple[list[int], list]:
    """(numbers of windows, sketches) of a bounded number of texts; they are made on the executors, only they (a few kB each) come to the driver."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [windows(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in found], pa.int64()), pa.array([sketch(w, shape).tobytes() for w in found], pa.binary())], names=["size", "values"])

    read = texts.mapInArrow(run, "size bigint, values binary").collect()
    return [r["size"] for r in read], [np.frombuffer(r["values"], dtype=np.uint64).reshape(shape) for r in read]


def _common(texts: DataFrame, most: float):
    """(windows, sorted; texts that hold each) of windows that are common among a bounded number of texts of at most ``most`` windows."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [w for w in map(windows, batch.column(0).to_pylist()) if len(w) <= most]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *found]).view(np.int64))], names=["key"])

    counts = texts.mapInArrow(run, "key bigint").groupBy("key").count().where(F.col("count") >= COMMON).collect()
    held = sorted((r["key"] & MASK, r["count"]) for r in counts)
    return np.array([k for k, _ in held], dtype=np.uint64), np.array([n for _, n in held], dtype=np.int64)


def _counted(ids: DataFrame) -> DataFrame:
    """The ids, marked for broadcast if they were counted and are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _alike(pairs: DataFrame, columns: tuple[str, str], verdict) -> DataFrame:
    """(a, b) of the pairs whose two values pass ``verdict``."""
    kinds = f"a {pairs.schema['a'].dataType.simpleString()}, b {pairs.schema['b'].dataType.simpleString()}"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = pa.array([verdict(x, y) for x, y in zip(left, right)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", *columns).mapInArrow(run, kinds)


def _verified(pairs: DataFrame, values: DataFrame, verdict, name: str) -> DataFrame:
    """(a, b) of the pairs whose two values pass ``verdict``; values: (row, value).

    Each pair lies beside a value while it is shuffled, so pairs go slice by slice, by a hash of ``a``.
    """
    slices = max(1, math.ceil(pairs.count() / (SLICE_PAIRS * max(1, values.count()))))
    passed = []
    for k in range(slices):
        own = lambda c: F.pmod(F.xxhash64(c), F.lit(slices)) == k  # noqa: B023, E731
        left = values.where(own("row")).select(F.col("row").alias("a"), F.col("value").alias("x"))
        both = pairs.where(own("a")).join(left, "a").join(values.select(F.col("row").alias("b"), F.col("value").alias("y")), "b")
        passed.append(materialise(_alike(both, ("x", "y"), verdict), name))
    return reduce(DataFrame.unionByName, passed)


def _met(firsts: DataFrame, count: int, similarity: float) -> DataFrame:
    """(a, b), a < b, each once: rows that share one of their ``count`` keys and whose travelling bits are close."""
    rounds = max(1, math.ceil(count / ROUND_KEYS))
    ends = [count * k // rounds for k in range(rounds + 1)]
    bits = [c for c in firsts.columns if c.startswith("bits")]
    met = [materialise(_meeting(firsts.select("row", *bits, F.explode(F.slice("keys", start + 1, end - start)).alias("key")), most_bits_apart(similarity)), "met") for start, end in zip(ends, ends[1:])]
    return met[0] if rounds == 1 else materialise(reduce(DataFrame.unionByName, met).distinct(), "pairs")


def _meeting(probes: DataFrame, apart: int = BITS) -> DataFrame:
    """(a, b), a < b: rows that share a key and of whose travelling bits at most ``apart`` differ; probes: (row, bits.., key).

    Keys of more than ``HOT_KEY`` rows are joined block by block: a row belongs to one block of its key
    and is laid beside every block, so any two rows of the key meet once, in the pair of their blocks.
    """
    bits = [c for c in probes.columns if c.startswith("bits")]
    close = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in bits)) <= apart
    met = lambda x, y, on: x.alias("a").join(y.alias("b"), on & (F.col("a.row") < F.col("b.row")) & close).select(F.col("a.row").alias("a"), F.col("b.row").alias("b"))
    same = F.col("a.key") == F.col("b.key")
    sizes = probes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_KEY)
    hot = materialise(sizes.select("key", F.ceil(F.col("n") / HOT_KEY).cast("int").alias("blocks")), "hot")
    if hot.isEmpty():
        return met(probes, probes, same).distinct()
    cold = probes.join(hot, "key", "left_anti")
    placed = probes.join(hot, "key").withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    beside = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = beside.select("row", *bits, "key", F.col("own").alias("x"), F.col("other").alias("y"))
    right = beside.select("row", *bits, "key", F.col("other").alias("x"), F.col("own").alias("y"))
    blocks = same & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    return met(cold, cold, same).unionByName(met(left, right, blocks)).distinct()


def _first_windows(texts: DataFrame, similarity: float, common) -> DataFrame:
    """(row, size, key): the windows of each text of which sets that overlap enough share one, common windows last."""
    known, counts = common

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def ordered(w):
            if not len(known):
                return w
            at = np.minimum(np.searchsorted(known, w), len(known) - 1)
            return w[np.argsort(np.where(known[at] == w, counts[at], 0), kind="stable")]

        for batch in batches:
            found = [ordered(windows(t)) for t in batch.column(1).to_pylist()]
            first = [w[: len(w) - math.ceil(similarity * len(w) - 1e-9) + 1] for w in found]
            at = np.repeat(np.arange(len(found)), [len(w) for w in first])
            flat = np.concatenate(first).view(np.int64) if first else np.zeros(0, dtype=np.int64)
            sizes = np.array([len(w) for w in found], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(sizes[at]), pa.array(flat)], names=["row", "size", "key"])

    return texts.mapInArrow(run, f"row {texts.schema['row'].dataType.simpleString()}, size bigint, key bigint")


def similar_classes(rows: DataFrame, row_id: str, group_id: str, title: str, body: str, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, links): (row, own, rep) of every long enough row, and (a, b), a < b, of linked classes."""
    with freeing(rows.sparkSession):
        return _similar_classes(rows, row_id, group_id, title, body, similarity)


def _similar_classes(rows: DataFrame, row_id: str, group_id: str, title: str, body: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    base = _base(rows, row_id, group_id, title, body)
    records = rows.count()
    share = min(1.0, ESTIMATE_RECORDS / max(1, records))
    picked = base.where(F.pmod(F.xxhash64("row"), F.lit(1_000_003)) < int(share * 1_000_003)).select("text").limit(2 * ESTIMATE_RECORDS)
    picked = materialise(picked, "picked")
    shape, thresholds = planned(picked, records, similarity)

    index = materialise(_sketched(base, thresholds, shape), "sketches")
    classes = index.groupBy("digest").agg(F.min("row").alias("rep"))
    members = materialise(index.select("row", "own", "digest").join(classes, "digest").select("row", "own", "rep"), "members")
    copies = members.where("row != rep").select("row")
    firsts = index.join(_counted(copies), "row", "left_anti")

    pairs = _met(firsts, sum(shape[0] if t else 1 for t in thresholds if t >= 0), similarity)
    least = (similarity - 5 * math.sqrt(similarity * (1 - similarity) / BYTES)) * BYTES

    def sketch_alike(x, y):
        import numpy as np

        return int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) >= least

    likely = _verified(pairs, firsts.select("row", F.col("bytes").alias("value")), sketch_alike, "likely")

    # texts of few windows: a partner that overlaps enough has at most so many more
    few = PART_WINDOWS * shape[1]
    if not firsts.where(F.col("size") < few).isEmpty():
        small = firsts.where(F.col("size") <= few / similarity).select(F.col("row").alias(row_id))
        read = rows.select(row_id, group_id, title, body).join(_counted(small), row_id, "left_semi")
        first = materialise(_first_windows(_base(read, row_id, group_id, title, body).select("row", "text"), similarity, _common(picked, few / similarity)), "first")
        near = F.least("a.size", "b.size") >= similarity * F.greatest("a.size", "b.size") - 1e-9
        met = first.where(F.col("size") < few).alias("a").join(first.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.row") != F.col("b.row")) & near)
        exact = met.select(F.least("a.row", "b.row").alias("a"), F.greatest("a.row", "b.row").alias("b")).distinct()
        likely = materialise(likely.unionByName(exact).distinct(), "likely")

    def windows_alike(x, y):
        import numpy as np

        p, q = windows(x), windows(y)
        both = len(np.intersect1d(p, q, assume_unique=True))
        return both >= similarity * (len(p) + len(q) - both) - 1e-9

    needed = likely.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    # the rows are narrowed before their texts are stripped again
    again = rows.select(row_id, group_id, title, body).join(_counted(needed.withColumnRenamed("row", row_id)), row_id, "left_semi")
    texts = materialise(_base(again, row_id, group_id, title, body).select("row", F.col("text").alias("value")), "texts")
    return members, _verified(likely, texts, windows_alike, "links")


def similar_pairs(rows: DataFrame, row_id: str, group_id: str, title: str, body: str, similarity: float = SIMILARITY) -> DataFrame:
    """(row_id_a, row_id_b), a < b: rows of different ids whose windows overlap enough."""
    members, links = similar_classes(rows, row_id, group_id, title, body, similarity)
    groups = members.select("rep", "own").distinct()
    left, right = groups.select(F.col("rep").alias("a"), F.col("own").alias("own_a")), groups.select(F.col("rep").alias("b"), F.col("own").alias("own_b"))
    several = groups.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rep").alias("a"))
    within = left.join(several, "a", "left_semi").join(right, F.col("a") == F.col("b")).where(F.col("own_a") < F.col("own_b"))
    across = links.join(left, "a").join(right, "b").where(F.col("own_a") != F.col("own_b"))
    pairs = within.select("a", "own_a", "b", "own_b").unionByName(across.select("a", "own_a", "b", "own_b"))
    x = members.select(F.col("rep").alias("a"), F.col("own").alias("own_a"), F.col("row").alias("x"))
    y = members.select(F.col("rep").alias("b"), F.col("own").alias("own_b"), F.col("row").alias("y"))
    found = pairs.join(x, ["a", "own_a"]).join(y, ["b", "own_b"])
    return found.select(F.least("x", "y").alias(f"{row_id}_a"), F.greatest("x", "y").alias(f"{row_id}_b"))


def classes(rows: DataFrame, row_id: str, group_id: str, title: str, body: str, similarity: float = SIMILARITY) -> DataFrame:
    """(row_id, class_id, links): one row for each long enough row, its class and the classes linked to that."""
    members, links = similar_classes(rows, row_id, group_id, title, body, similarity)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return members.join(degree, "rep", "left").select(F.col("row").alias(row_id), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
