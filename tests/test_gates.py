"""Gates, fingerprints and choices on small frames."""

import pytest
from pyspark.sql import functions as F

from skein.operators import gates as G


def test_fingerprint_depends_on_order_and_content(spark):
    rows = [(1, "a", None), (2, "b", "x"), (3, "c", "y")]
    make = lambda r: tuple(G.pool_fingerprint(spark.createDataFrame(r, "i int, a string, b string"), "i", ["a", "b"], []).first())
    same = make(rows)
    assert make(rows[::-1]) == same  # the place is data, not the order of arrival
    assert make([(2, "a", None), (1, "b", "x"), (3, "c", "y")]) != same and make([(1, "a", ""), *rows[1:]]) == same  # the format has no null
    assert make([])[0] == 0


def test_choice_is_repeatable_and_eligible(spark):
    df = spark.createDataFrame([(k, t, t % 3 == 1 and k < 20) for k in range(40) for t in range(5)], "k int, t int, ok boolean")
    one, two = (sorted(map(tuple, G.chosen_turn(df, ["k"], "t", F.col("ok"), 3).collect())) for _ in range(2))
    assert one == two and len(one) == 40
    assert all(t in (1, 4) for k, t in one if k < 20) and all(t == 2 for k, t in one if k >= 20)
    assert len({t for k, t in one if k < 20}) == 2


def test_typed_columns(spark):
    df = spark.createDataFrame([("1.5", "x"), (None, None), ("true", "2")], "a string, b string")
    a = [r.a for r in G.typed_column(df, "a").collect()]
    assert a[0] == 1.5 and a[1] != a[1] and a[2] == 1.0
    assert [r.b for r in G.typed_column(df, "b").collect()] == ["x", "", "2"]


def test_gates(spark):
    df = spark.createDataFrame([(True, True, False), (None, None, None)], "t boolean, e boolean, l boolean")
    assert G.integrity_gate(df, F.col("t"), F.col("e"), F.col("l"), 0.5).first()[:] == (2, 0.5, 1, 0, False)
    assert G.integrity_gate(df.limit(0), F.col("t"), F.col("e"), F.col("l"), 0.5).first()[:] == (0, 0.0, 0, 0, True)
    ids = spark.createDataFrame([("a",), ("b",)], "k string")
    G.same_key_set(ids, ids, "k")
    with pytest.raises(ValueError, match="b"):
        G.same_key_set(ids, ids.limit(0).union(ids.where("k = 'a'")), "k")
