import random

from conftest import rows
from loomwright.llm import nearcopy

S = "record_id long, id string, title string, content_text string, row string, key string, n long"


def jaccard(a, b):
    w = lambda t: {t[i : i + 5] for i in range(len(t) - 4)}
    x, y = w(a), w(b)
    return len(x & y) / len(x | y)


def corpus(seed=3):
    r = random.Random(seed)
    char = lambda: chr(0x4E00 + r.randrange(3000))
    data = []
    for g in range(60):
        base = [char() for _ in range(r.randrange(310, 900))]
        for v in range(r.randrange(1, 4)):
            text = list(base)
            for _ in range(r.randrange(0, len(base) // 14) if v else 0):
                text[r.randrange(len(text))] = char()
            if v == 2:
                text = text[len(text) // 10 :] + [char() for _ in range(30)]
            data.append((len(data), f"id{g}-{v}" if g % 5 else f"id{g}", f"题{g}", " ".join(text), "r", "k", 1))
    return data


def brute(data):
    keyed = [(d[0], d[1], "".join(((d[2] or "") + d[3]).split())) for d in data if d[3] and len("".join(d[3].split())) >= nearcopy.LEAST_CHARS]
    return sorted((a, b) for a, i, x in keyed for b, j, y in keyed if a < b and i != j and jaccard(x, y) >= nearcopy.SIMILARITY)


def test_as_brute_force(spark):
    data = corpus()
    found = rows(nearcopy.similar_pairs(spark.createDataFrame(data, S), "record_id", "id", "title", "content_text"))
    assert found == brute(data) and len(found) > 20


def test_edges(spark):
    long = "".join(chr(0x4E00 + i) for i in range(400))
    data = [
        (1, "a", None, long, "", "", 0), (2, "b", None, long, "", "", 0), (3, "a", None, long, "", "", 0), (4, "c", "", long[:299], "", "", 0), (5, "d", "", None, "", "", 0), (6, "e", "", "", "", "", 0),
        (7, None, "", long, "", "", 0), (8, "f", "x", "z" * 100_000, "", "", 0), (9, "g", "x", " ".join("z" * 500), "", "", 0),
    ]
    df = spark.createDataFrame(data, S)
    # copies of one id are no pair, copies under other ids are; one window over and over is one window
    assert rows(nearcopy.similar_pairs(df, "record_id", "id", "title", "content_text")) == [(1, 2), (2, 3), (8, 9)]
    assert rows(nearcopy.similar_pairs(df.limit(0), "record_id", "id", "title", "content_text")) == []


def test_classes(spark):
    data = corpus()
    out = nearcopy.classes(spark.createDataFrame(data, S), "record_id", "id", "title", "content_text").collect()
    assert len(out) == len(data) and {r["record_id"] for r in out} == {d[0] for d in data} and any(r["links"] for r in out)


def test_thresholds_keep_the_bound():
    import math

    for records, estimates in ((1e5, [{0: 10.0, 1: 1e6}] * 64), (1e3, [{0: 1.0, 1: 2.0}] * 64), (1e6, [{0: 1e9, 1: 1e10}] * 8 + [{0: 5.0, 1: 1e5}] * 56)):
        _, chosen = nearcopy.allocate(estimates, 4, records)
        missed = math.prod(1 - nearcopy.hit_probability(t, 4, nearcopy.SIMILARITY) for t in chosen if t >= 0)
        assert missed <= nearcopy.MISS * 1.05
    # parts that are costly are skipped while others reach the bound
    assert chosen[:8] == [-1] * 8
    # chance candidates grow with the square of the records, keys only with their number: more records take wider parts
    least = lambda records: min(nearcopy.WIDTHS, key=lambda w: nearcopy.allocate([{0: records**2 * 20.0 ** (-w - 3), 1: records**2 * 20.0 ** (-w - 2)}] * nearcopy.shape_of(w)[1], w, records)[0])
    assert least(1e4) == 4 and least(1e9) > 4


def test_repetitive_texts_as_brute_force(spark):
    r = random.Random(5)
    char = lambda: chr(0x4E00 + r.randrange(3000))
    data = []
    for g in range(150):
        unit = [char() for _ in range(r.randrange(12, 60))]
        for v in range(3):
            own = list(unit)
            for _ in range(v and r.randrange(1, 1 + max(1, len(unit) // 16))):
                own[r.randrange(len(own))] = char()
            data.append((len(data), f"id{g}-{v}", None, "".join(own) * (320 // len(own) + 1), "r", "k", 1))
    found = rows(nearcopy.similar_pairs(spark.createDataFrame(data, S), "record_id", "id", "title", "content_text"))
    assert found == brute(data) and len(found) > 100


def test_five_values_as_brute_force(spark, monkeypatch):
    data = corpus(11)
    monkeypatch.setattr(nearcopy, "WIDTHS", (5,))
    found = rows(nearcopy.similar_pairs(spark.createDataFrame(data, S), "record_id", "id", "title", "content_text"))
    assert found == brute(data) and len(found) > 20


def test_hot_keys_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(nearcopy, "HOT_KEY", 7)
    r = random.Random(4)
    data = [(i, r.getrandbits(3), k) for i in range(60) for k in ({1} if i % 3 else {1, i % 5 + 2})]
    found = rows(nearcopy._meeting(spark.createDataFrame(data, "row long, bits long, key long")))
    assert found == sorted({(a, b) for a, _, k in data for b, _, m in data if a < b and k == m})


def patched(count, blocks, pool, chars, seed):
    """Texts of some of a pool of blocks: any two share a fifth to a quarter of their windows, each pair others."""
    r = random.Random(seed)
    drawn = ["".join(chr(0x4E00 + r.randrange(20000)) for _ in range(chars)) for _ in range(pool)]
    return [(i, f"id{i}", None, "".join(r.sample(drawn, blocks)), "r", "k", 1) for i in range(count)]


def test_chance_candidates_are_dropped_while_the_index_is_probed(spark, monkeypatch):
    data = patched(150, 12, 38, 40, 7)
    beside, alike = [], nearcopy._alike

    def counted(pairs, *rest):
        beside.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(nearcopy, "_alike", counted)
    monkeypatch.setattr(nearcopy, "WIDTHS", (4,))
    data.append((150, "copy", None, data[0][3][:-9], "r", "k", 1))
    found = rows(nearcopy.similar_pairs(spark.createDataFrame(data, S), "record_id", "id", "title", "content_text"))
    assert found == brute(data) and (0, 150) in found
    # what is written for each candidate decides the disk: few of the 11,175 pairs may get so far
    assert sum(beside) < 200


def test_width_counts_the_pairs_it_needs_exactly(spark):
    texts = spark.createDataFrame([(d[3],) for d in patched(300, 10, 23, 30, 8)], "text string")
    # wider parts meet fewer by chance, but with their number of parts all of these texts have few windows
    assert nearcopy.planned(texts, 4_000_000, nearcopy.SIMILARITY)[0][0] == 4


def test_rounds_and_slices_as_brute_force(spark, monkeypatch):
    for name, value in (("ROUND_KEYS", 7), ("SLICE_PAIRS", 0.1), ("HOT_KEY", 2)):
        monkeypatch.setattr(nearcopy, name, value)
    data = corpus(12)
    found = rows(nearcopy.similar_pairs(spark.createDataFrame(data, S), "record_id", "id", "title", "content_text"))
    assert found == brute(data) and len(found) > 20


def test_shuffle_files_are_freed_by_each_write(spark, monkeypatch):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen, write = spark.conf.get(name, None), [], nearcopy.materialise
    monkeypatch.setattr(nearcopy, "materialise", lambda df, label: seen.append(spark.conf.get(name, None)) or write(df, label))
    nearcopy.similar_classes(spark.createDataFrame(corpus(13), S), "record_id", "id", "title", "content_text")
    assert seen and set(seen) == {"true"} and spark.conf.get(name, None) == before
