import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from loomwright.operators import scan

ROW = st.tuples(st.sampled_from(["hot", "hot", "hot", "a", None]), st.one_of(st.none(), st.integers(0, 30)), st.one_of(st.none(), st.integers(-3, 3)))


def brute(data, value):
    """Per row: running sum, last value before, last value up to it."""
    out, state = [], {}
    for k, o, v, i in sorted(data, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[3])):
        total, last = state.get(k, (0, None))
        now = (total + (v or 0), v if v is not None else last)
        out.append((i, now[0], last, now[1]))
        state[k] = now
    return sorted(out, key=lambda r: r[0])


@settings(max_examples=12, deadline=None)
@given(st.lists(ROW, min_size=1, max_size=60), st.sampled_from([None, 1, 7]))
def test_as_brute_force(spark, data, width):
    data = [(*r, i) for i, r in enumerate(data)]
    df = spark.createDataFrame(data, "k string, o int, v int, i long")
    chunk = None if width is None else F.floor(F.col("o") / width)
    order = [F.col("o"), F.col("i")]
    out = scan.running_sums(df, ["k"], order, {"s": F.col("v")}, chunk)
    out = scan.last_values(out, ["k"], order, {"b": F.col("v")}, chunk)
    out = scan.last_values(out, ["k"], order, {"n": F.col("v")}, chunk, inclusive=True)
    assert rows(out.select("i", "s", "b", "n")) == brute(data, "v")


@pytest.mark.parametrize("inclusive", [True, False])
def test_up_to_first(spark, inclusive):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), (None, 1, None), ("b", None, True), ("b", 1, False)], "k string, o int, hit boolean")
    found = [(r[0], r[1]) for r in rows(scan.up_to_first(df, ["k"], [F.col("o")], F.col("hit"), inclusive))]
    assert found == [(None, 1), ("a", 1), *([("a", 2), ("b", None)] if inclusive else [])]
