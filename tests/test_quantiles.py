import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import quantiles as q


def test_linear_quantile_toy(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    assert q.exact_quantiles(df, ["x"], [0.25])["x"][0] == pytest.approx(1.75)


def test_qcut_right_closed_duplicates_dropped(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 2, 3, 4, 5, 6]], "x double")
    edges = q.qcut_edges(df, ["x"], 4)["x"]
    bins = [r[0] for r in df.select(q.bin_by_edges(F.col("x"), edges)).collect()]
    assert bins == [0, 0, 0, 0, 1, 1, 2, 2]


def test_constant_column_has_no_bins(spark):
    df = spark.createDataFrame([(3.0,)] * 6, "x double")
    assert q.qcut_edges(df, ["x"], 5)["x"] == []
    assert all(r[0] is None for r in df.select(q.bin_by_edges(F.col("x"), [])).collect())


@pytest.mark.parametrize("kw", [{}, {"accuracy": 100}, {"accuracy": 20}])
def test_exact_quantiles_match_numpy_wide(spark, kw):
    rng = np.random.default_rng(7)
    a = rng.normal(size=4000).round(2)          # many ties
    b = rng.integers(0, 5, size=4000).astype(float)  # heavy ties
    c = rng.exponential(size=4000)
    pdf = [(float(x), float(y), float(z)) for x, y, z in zip(a, b, c)]
    df = spark.createDataFrame(pdf, "a double, b double, c double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    res = q.exact_quantiles(df, ["a", "b", "c"], probs, **kw)
    for name, arr in (("a", a), ("b", b), ("c", c)):
        assert np.allclose(res[name], np.quantile(arr, probs), atol=1e-12)


@pytest.mark.parametrize("kw", [{}, {"accuracy": 100}])
def test_grouped_quantiles_match_numpy(spark, kw):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 20, size=5000)
    v = rng.gamma(2.0, size=5000).round(3)
    df = spark.createDataFrame([(str(int(x)), float(y)) for x, y in zip(g, v)], "__g string, __v double")
    probs = [0.25, 0.5, 0.75]
    res = q.grouped_quantiles(df, probs, **kw)
    for k in range(20):
        assert np.allclose(res[str(k)], np.quantile(v[g == k], probs), atol=1e-12)


def test_nulls_ignored(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert q.exact_quantiles(df, ["x"], [0.5])["x"][0] == pytest.approx(2.0)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (3.0,)], "x double")
    assert q.exact_quantiles(df, ["x"], [0.5])["x"][0] == pytest.approx(2.0)


def test_class_table_has_every_class(spark):
    rows = [("a", 1.0), ("a", 3.0), (None, 5.0), ("new", 7.0), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: (r["n"], list(r["q"])) for r in q.class_quantile_table(df, ["x"], "k", [0.0, 0.5]).collect()}
    assert got == {"a": (2, [1.0, 2.0]), None: (1, [5.0, 5.0]), "new": (1, [7.0, 7.0])}


def test_many_rows_take_the_same_path(spark):
    df = spark.range(600_000).select(((F.col("id") * 7919) % 600_000).cast("double").alias("x"), (F.col("id") % 3).alias("k"))
    res = q.exact_quantiles(df, ["x"], [0.0, 0.1, 0.5, 0.999, 1.0])["x"]
    assert np.allclose(res, np.quantile(np.arange(600_000.0), [0.0, 0.1, 0.5, 0.999, 1.0]))


def test_a_bad_sketch_is_searched_again(spark):
    """Brackets that miss every rank lead to further passes, never to a wrong value."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=3000)
    long = spark.createDataFrame([("a", float(v)) for v in x], "__g string, __v double")
    n_grid = len(q._grid([0.1, 0.5], q.rank_margin()))
    wrong = spark.createDataFrame([("a", 3000, float(x.min()), float(x.max()), [2.9 + i * 1e-4 for i in range(n_grid)])],
                                  "__g string, n bigint, least double, greatest double, s array<double>")
    got = {r["p"]: r["q"] for r in q.quantile_table(long, [0.1, 0.5], sketch=wrong).collect()}
    assert got == pytest.approx({p: np.quantile(x, p) for p in (0.1, 0.5)}, abs=1e-12)


def test_stored_sketches_bracket_exact_quantiles(spark, tmp_path):
    """Sketches of two parts, stored, and of a third appended later: merged quantiles lie within the margin, and exact ones
    take their brackets from them."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=20_000), rng.exponential(size=30_000) * 50, np.full(15_000, 3.0)])
    df = spark.createDataFrame([(int(i // 22_000), float(v), float(-v)) for i, v in enumerate(x)], "day int, x double, y double")
    path = str(tmp_path / "sketches")
    q.part_sketches(df.where("day < 2"), ["x", "y"], "day").write.parquet(path)
    q.part_sketches(df.where("day = 2"), ["x", "y"], "day").write.mode("append").parquet(path)
    sketches = spark.read.parquet(path)
    assert sketches.count() == 6
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    ordered = {"x": np.sort(x), "y": np.sort(-x)}
    for r in q.approx_from_sketches(sketches, probs).collect():
        v = ordered[r["column_name"]]
        lo, hi = np.searchsorted(v, r["q"], "left") / len(v), np.searchsorted(v, r["q"], "right") / len(v)
        assert r["n"] == len(x) and lo - q.rank_margin() <= r["p"] <= hi + q.rank_margin()
    exact = q.quantile_table(q.to_long(df, ["x", "y"]), probs, sketch=q.brackets_of(sketches, probs))
    for r in exact.collect():
        assert r["q"] == pytest.approx(np.quantile(ordered[r["__g"]], r["p"]), abs=1e-12)


def test_plan_has_no_range_partitioning(spark):
    """Entries are shuffled by group and segment: no sampling job, and no group or bracket in one task."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    long = q.to_long(df, ["x"])
    b = q._brackets(q.sketch_table(long, [0.5], ["__g"]), ["__g"], [0.5], q.rank_margin())
    placed = q._placed(q._entries(long, b, ["__g"], 1, q.CUTS + 1), ["__g"])
    plan = placed._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan
    rows = placed.orderBy("upto").collect()
    assert rows[-1]["upto"] == 1000 and sum(r["n"] for r in rows) == 1000
