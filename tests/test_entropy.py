import math

import pytest

from cohortspark.operators import entropy as en


def _h(ps):
    return -sum(p * math.log2(p) for p in ps if p > 0)


def test_information_gain_by_hand(spark):
    rows = [("a", 1.0, "x"), ("a", 2.0, "x"), ("b", 3.0, "y"), ("b", 4.0, "x")]
    df = spark.createDataFrame(rows, "t string, v double, c string")
    ig = {r["feature"]: r for r in en.information_gain(df, "t", ["v"], ["c"], bins=2).collect()}
    # c: x -> {a, a, b}, y -> {b}
    expected = _h([0.5, 0.5]) - 0.75 * _h([2 / 3, 1 / 3])
    assert ig["c"]["information_gain"] == pytest.approx(expected)
    # v: median 2.5 splits {a, a} | {b, b} -> perfect
    assert ig["v"]["information_gain"] == pytest.approx(1.0)
    assert ig["v"]["rank"] == 1


def test_constant_feature_gains_zero(spark):
    df = spark.createDataFrame([(str(i % 2), 5.0) for i in range(6)], "t string, v double")
    ig = en.information_gain(df, "t", ["v"]).first()
    assert ig["information_gain"] == 0.0


def test_null_policies_differ(spark):
    rows = [("a", 1.0), ("a", 1.0), ("b", 9.0), ("b", None), ("a", None), ("b", 9.0), ("a", 1.0), ("b", 9.0),
            ("a", None), ("b", 1.0)]
    df = spark.createDataFrame(rows, "t string, v double")
    drop = en.information_gain(df, "t", ["v"], bins=2, null_policy="drop").first()["information_gain"]
    ref = en.information_gain(df, "t", ["v"], bins=2, null_policy="reference").first()["information_gain"]
    assert drop != pytest.approx(ref)


def test_row_entropy(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (0.0, -1.0, 0.0), (2.0, 2.0, 4.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(en.row_entropy(["a", "b", "c"])).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0 and got[2] == pytest.approx(1.5)
