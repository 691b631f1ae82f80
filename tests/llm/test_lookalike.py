import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from loomwright.llm import lookalike


def forms(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "id long, title string, text string, form string")
    return {r["text"]: r["form"] for r in lookalike.canonical_texts(df, "title").collect()}


def test_readings_that_are_equal(spark):
    groups = [
        ["Énerval示范（2024）", "Énerval示范(２０２４)", "Énerval​ 示 范（2024）", "Én­erval示范（2024）"],
        ["БМS" .replace("Б", "В"), "BMS", "ＢＭＳ", "ΒΜЅ"],
        ["“风电”", '"风电"', "「风电」"],
        ["2024-1", "2024‑1", "2024－1", "2024−1"],
        ["⽔电⻓期", "水电长期"],
        ["二○二三年", "二〇二三年"],
        ["ﬁre", "fire"],
        ["가나", "가나", "각".replace("각", "가") + "나"],
        ["ạ̇", "ạ̇", "ạ̇"],
    ]
    found = forms(spark, [t for g in groups for t in g])
    for g in groups:
        assert len({found[t] for t in g}) == 1, [(t, found[t]) for t in g]
    assert len({found[g[0]] for g in groups}) == len(groups)


def test_readings_that_differ(spark):
    texts = ["BMS", "bms", "BM5", "第1号", "第2号", "énerval", "enerval", "", None, " 　", "𠮷野", "吉野", "x́"]
    found = forms(spark, texts)
    assert found[""] == "" and found[" 　"] == "" and None not in found
    assert found["𠮷野"] == "𠮷野" and found["x́"] == "x́"
    kept = [t for t in texts if t and t.strip()]
    assert len({found[t] for t in kept}) == len(kept)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", categories=["L", "M", "N", "P", "Z", "S"]), max_size=12), min_size=1, max_size=30, unique=True))
def test_as_brute_force(spark, texts):
    table = lookalike.mapping()
    found = forms(spark, texts)
    for t in texts:
        mapped = "".join(table.get(c, c) for c in t)
        assert unicodedata.normalize("NFD", found[t]) == unicodedata.normalize("NFD", mapped), t


def test_pairs_of_rows(spark):
    df = spark.createDataFrame([(1, "BMS"), (2, "BMS"), (3, "ＢMS"), (4, None), (5, "x"), (6, "x"), (7, ""), (8, " ")], "record_id long, title string")
    assert rows(lookalike.same_reading_pairs(df, "record_id", "title")) == [(1, 3), (2, 3), (7, 8)]
    assert rows(lookalike.same_reading_pairs(df.limit(0), "record_id", "title")) == []


def test_whole_scripts_that_copy_latin_letters(spark):
    for pair in lookalike.COPIES.split():
        assert len(pair) == 2 and lookalike.mapping()[pair[0]] == pair[1], pair
    assert all(lookalike.mapping()[c] == '"' for c in "ʼʹ") and lookalike.mapping()["─"] == "-"
    df = spark.createDataFrame([(1, "ꓐꓟꓢ"), (2, "BMS"), (3, "ⲂⲘS"), (4, "ᗷᗰS"), (5, "bms"), (6, "ᴠᴏꮯ"), (7, "voc")], "i long, t string")
    assert rows(lookalike.same_reading_pairs(df, "i", "t")) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7)]
