from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from loomwright.llm import bisect


def whole(parts, overlap):
    return parts[0]["text"] + "".join(p["text"][overlap:] for p in parts[1:])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 。\n，.é", max_size=400), st.integers(12, 60))
def test_nothing_is_lost(text, limit):
    overlap = limit // 4
    parts = bisect.split(text, limit, overlap)
    assert whole(parts, overlap) == text
    assert all(len(p["text"]) <= limit for p in parts)
    assert all(a["text"][-overlap:] == b["text"][:overlap] for a, b in zip(parts, parts[1:]))
    assert all(p["text"] == text[p["start"] : p["start"] + len(p["text"])] for p in parts)
    assert (len(parts) == 1) == (len(text) <= limit)


def test_strongest_boundary_near_the_middle():
    text = "x" * 45 + "，" + "x" * 3 + "。" + "x" * 50
    assert bisect.cut_near(text, 0, len(text)) == 50
    text = "x" * 30 + "\n\n" + "x" * 18 + "。" + "x" * 50
    assert bisect.cut_near(text, 0, len(text)) == 32
    assert bisect.cut_near("y" * 100, 0, 100) == 50
    assert "é" in bisect.split("é" * 30, 31, 5)[0]["text"][-2:]


def test_rows(spark):
    long = "句子。" * 1500
    df = spark.createDataFrame([(1, long, "clash"), (1, long, "clash"), (2, "short", ""), (3, "", ""), (4, None, "")], "k long, body string, piece_no string")
    out = bisect.split_items(df, ["k"], "body").collect()
    assert [r["text"] for r in out if r["k"] == 2] == ["short"] and [r["text"] for r in out if r["k"] == 3] == [""] and not [r for r in out if r["k"] == 4]
    one = sorted((r["piece_no"], r["start"], r["text"]) for r in out if r["k"] == 1)
    assert one[0][0] == 1 and one[0] == one[1] and all(t.endswith("。") for _, _, t in one)
    assert rows(bisect.split_items(df.limit(0), ["k"], "body")) == []
