import random

from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from loomwright.llm import leakage


def edit(p, t):
    """Smallest edit distance of p to a substring of t, by the plain table."""
    last = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        row = [i]
        for j, d in enumerate(t, 1):
            row.append(min(last[j - 1] + (c != d), last[j] + 1, row[-1] + 1))
        last = row
    return min(last)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=70), st.text("abc", max_size=90))
def test_myers(pattern, text):
    assert leakage.myers(pattern, text) == edit(pattern, text)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 64), st.lists(st.tuples(st.text("abc", min_size=64, max_size=64), st.text("abc", max_size=40)), min_size=1, max_size=8))
def test_myers_of_many(m, pairs):
    import numpy as np

    codes = lambda strings, n: np.array([[ord(c) for c in x.ljust(n, "\0")] for x in strings], dtype=np.uint32)
    assert leakage.myers_many(codes([p[:m] for p, _ in pairs], m), codes([t for _, t in pairs], 40)).tolist() == [edit(p[:m], t) for p, t in pairs]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_as_brute_force(data):
    errors = data.draw(st.integers(0, 2))
    item = data.draw(st.text("ab", min_size=10, max_size=30))
    at = data.draw(st.integers(0, len(item) - 8))
    text = data.draw(st.text("abx", max_size=20)) + item[at : at + 14] + data.draw(st.text("abx", max_size=20))
    matcher = leakage.Matcher([(7, item)], window=10, errors=errors)
    expected = any(edit(item[i : i + 10], text) <= errors for i in range(len(item) - 9)) and len(text) >= 10 - errors
    assert (matcher.leaks([text, None, '']) == [[7], [], []]) == expected


def test_rows(spark):
    r = random.Random(2)
    item = "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(120))
    spaced = " ，".join(item[30:70])
    docs = [(1, "前文" + item[50:90] + "后文"), (2, item[50:89]), (3, spaced), (4, None), (5, ""), (6, "ＡＢＣ" * 20), (7, item * 500), (8, item[50:90]), (8, item[50:90])]
    items = [(1, item), (2, item), (3, None), (4, ""), (5, "abc" * 20), (6, "short")]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    both = [(i, k) for i in (1, 3, 7, 8, 8) for k in (1, 2)]
    expected = sorted([*both, (6, 5)])
    assert rows(leakage.leaking_documents(d, q)) == expected
    assert rows(leakage.leaking_documents(d, q, block_chars=150)) == expected  # items in several blocks
    assert rows(leakage.leaking_documents(d.limit(0), q)) == [] and rows(leakage.leaking_documents(d, q.limit(0))) == []
    one_edit = item[10:30] + "错" + item[31:60]
    e = spark.createDataFrame([(1, one_edit)], "doc_id long, text string")
    assert rows(leakage.leaking_documents(e, q)) == [] and len(rows(leakage.leaking_documents(e, q, errors=1))) == 2
