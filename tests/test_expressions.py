from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.functions import expressions as E


def test_selection_grammar():
    assert E.parse_selection("3:2", 10) == [3, 4]
    assert E.parse_selection("7,1,1,99", 10) == [1, 7]
    assert E.parse_selection(None, 5, 8) == [0, 1, 2, 3, 4]
    assert E.parse_ranges("0-3,5") == [0, 1, 2, 3, 5]


@given(st.integers(0, 300), st.integers(1, 40))
def test_even_spread(size, n):
    places = E.even_spread(size, n)
    assert places == sorted(set(places)) and len(places) <= max(n, 0 if not size else 1)
    assert not size or (places[0] == 0 and (n == 1 or places[-1] == size - 1 or size == 0))


def test_guards(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in rows.select(E.finite_or("x")).collect()] == [1.0, 0.0, 0.0, 0.0]
    row = spark.range(1).select(E.ceil_div(F.lit(10), 3), E.round_down(F.lit(10), 4), E.next_power_of_two(F.lit(100)), E.clip(F.lit(5.0), 0.0, 1.0), E.fold_ewma(F.array(F.lit(1.0), F.lit(3.0)), 0.5), E.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))).first()
    assert list(row)[:5] == [4, 8, 128, 1.0, 2.0] and abs(row[5] - 0.5**0.5) < 1e-12
