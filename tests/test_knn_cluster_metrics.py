import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import cluster as cl
from cohortspark.operators import impute as im
from cohortspark.operators import metrics as me
from cohortspark.operators.knn import knn_join


def _nan_euclid(a, b):
    both = [(x, y) for x, y in zip(a, b) if x is not None and y is not None]
    if not both:
        return None
    return math.sqrt(len(a) / len(both) * sum((x - y) ** 2 for x, y in both))


def test_knn_join_exact_vs_brute_force(spark):
    rng = np.random.default_rng(11)
    n = 300
    xs = rng.normal(size=(n, 4)).round(1)
    rows = []
    for i in range(n):
        v = [float(x) for x in xs[i]]
        if i % 7 == 0:
            v[2] = None
        rows.append((i, *v))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    q = df.where(F.col("id") < 40)
    d = df.where(F.col("id") >= 40)
    feats = ["a", "b", "c", "d"]
    got = knn_join(q, d, ["id"], ["id"], feats, 5, ["a", "b"], metric="nan_euclidean", occupancy=2)
    got = {(r["id"], r["nn_rank"]): r["d_id"] for r in got.collect()}
    for qi in range(40):
        dist = sorted((_nan_euclid(rows[qi][1:], rows[j][1:]), j) for j in range(40, n))
        for k, (_, j) in enumerate(dist[:5], 1):
            assert got[(qi, k)] == j


def test_knn_fill_by_hand(spark):
    rows = [(1, 1.0, 2.0, None), (2, 1.0, 4.0, 10.0), (3, 3.0, 2.0, 20.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    out = im.knn_fill(df, ["id"], ["a", "b", "c"], grid=["a", "b"], k=2, targets=["c"], occupancy=1)
    got = {r["id"]: r["c"] for r in out.collect()}
    d2 = math.sqrt(3 / 2 * 4.0)  # to id 2: (b 2 vs 4)
    d3 = math.sqrt(3 / 2 * 4.0)  # to id 3: (a 1 vs 3)
    assert got[1] == pytest.approx((10 / d2 + 20 / d3) / (1 / d2 + 1 / d3))


def test_auc_rank_sum_equals_pair_count(spark):
    rng = np.random.default_rng(5)
    s = rng.integers(-3, 4, size=500).astype(float) * 0.5
    s[s == 0] = -0.0
    y = (rng.random(500) < 0.4).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    pos, neg = s[y == 1], s[y == 0]
    pairs = sum((p > n_) + 0.5 * (p == n_) for p in pos for n_ in neg) / (len(pos) * len(neg))
    assert me.roc_auc(df, "y", "s") == pytest.approx(pairs, abs=1e-12)


def test_kappa_and_complete_confusion(spark):
    rows = [(0, 0)] * 20 + [(0, 1)] * 5 + [(1, 1)] * 15 + [(1, 0)] * 10
    df = spark.createDataFrame(rows, "y int, p int")
    conf = me.confusion(df, "y", "p", [0, 1, 2])
    assert conf.count() == 9
    k = me.cohen_kappa(conf).first()
    po = 35 / 50
    pe = (25 * 30 + 25 * 20) / 2500
    assert k["kappa"] == pytest.approx((po - pe) / (1 - pe))


def test_elbow_on_literal_wcss(spark):
    w = [100, 60, 40, 33, 29, 26, 24, 23, 22]
    sweep = spark.createDataFrame([(k, float(v), 0.1 * k) for k, v in zip(range(2, 11), w)],
                                  "k int, wcss double, silhouette double")
    r = cl.elbow(sweep).first()
    d1 = np.diff(w)
    d2 = np.diff(d1)
    assert r["elbow_k"] == int(np.argmax(np.abs(d2)) + 4)
    assert r["best_silhouette_k"] == 10


def test_rank_sum_labels_each_once(spark):
    rows = [(0, 10.0, 0.1, 80.0, 50.0, 27.0), (1, 30.0, 0.5, 100.0, 45.0, 33.0),
            (2, 12.0, 0.2, 85.0, 60.0, 26.0), (3, 15.0, 0.2, 90.0, 47.0, 31.0)]
    med = spark.createDataFrame(rows, "cluster int, lap double, log_tg_hdl double, waist_circumference double, "
                                      "age double, bmi double")
    lab = {r["cluster"]: r["phenotype"] for r in cl.rank_sum_labels(med).collect()}
    assert sorted(lab.values()) == ["MARD", "MOD", "SIDD", "SIRD"]
    assert lab[1] == "SIRD" and lab[2] == "MARD" and lab[3] == "MOD" and lab[0] == "SIDD"


def test_silhouette_rows_vs_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.random((60, 2))
    c = rng.integers(0, 3, size=60)
    df = spark.createDataFrame([(i, float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(x, c))],
                               "id long, a double, b double, cluster int")
    got = {r["id"]: r["silhouette"] for r in cl.silhouette_rows(df, ["id"], ["a", "b"]).collect()}
    for i in range(60):
        d = ((x - x[i]) ** 2).sum(axis=1)
        own = c == c[i]
        a = d[own].sum() / max(own.sum() - 1, 1)
        b = min(d[c == k].mean() for k in set(c) if k != c[i])
        s = 0.0 if own.sum() == 1 else (b - a) / max(a, b)
        assert got[i] == pytest.approx(s, abs=1e-9)


def test_rank_within_group_matches_window(spark):
    from pyspark.sql import Window
    from cohortspark.operators.profile import rank_within_group
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("g"),
                                  ((F.col("id") * 7919) % 101).alias("v"))
    got = rank_within_group(df, ["g"], [F.col("v").desc(), F.col("id")], out="r", partitions=7)
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc(), "id")))
    assert sorted(got.select("id", "r").collect()) == sorted(ref.select("id", "r").collect())


def test_rank_within_group_beyond_the_range_sample(spark):
    """More rows than a range sample sees, extra columns, a NULL group: equal to row_number()."""
    from pyspark.sql import Window
    from cohortspark.operators.profile import rank_within_group
    df = spark.range(600_000).select(
        F.col("id"), F.when(F.col("id") % 10 > 2, F.col("id") % 3).cast("int").alias("g"), ((F.col("id") * 7919) % 100_003).alias("v"),
        (F.col("id") * 0.5).alias("x1"), F.col("id").cast("string").alias("x2"), F.lit("z").alias("x3"))
    got = rank_within_group(df, ["g"], [F.col("v").desc(), F.col("id")], out="r")
    ref = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc(), "id")).alias("want"))
    assert got.columns == [*df.columns, "r"] and got.count() == 600_000
    assert got.join(ref, "id").where(F.col("r") != F.col("want")).count() == 0


def test_confusion_keeps_unlisted_and_null_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "zz"), ("q", "a"), (None, "b"), ("b", None)], "y string, p string")
    conf = me.confusion(df, "y", "p", ["a", "b", "never"])
    rows = {(r["label"], r["prediction"]): r["n"] for r in conf.collect()}
    assert sum(rows.values()) == 5 and len(rows) == 36
    assert rows["b", "zz"] == rows["q", "a"] == rows[None, "b"] == rows["b", None] == 1
    k = me.cohen_kappa(conf).first()
    assert k["observed_agreement"] == pytest.approx(0.2)


def test_null_class_is_split_like_the_others(spark):
    from cohortspark.operators import split as sp
    df = spark.range(2000).select("id", F.when(F.col("id") < 1000, "c").alias("y"))
    n = {(r["y"], r["split"]): r["count"] for r in sp.exact_stratified_split(df, ["id"], "y").groupBy("y", "split").count().collect()}
    assert n == {("c", "train"): 700, ("c", "test"): 300, (None, "train"): 700, (None, "test"): 300}
    folds, table = sp.group_folds(df, "y")
    assert {(r["y"], r["fold"]) for r in folds.select("y", "fold").distinct().collect()} == {("c", 0), (None, None)}
    assert folds.count() == 2000 and table.count() == 1


def test_range_overlap_of_a_class_without_values(spark):
    from cohortspark.operators import leakage as lk
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (0, None)], "y int, x double")
    r = lk.range_overlap(df, "y", ["x"]).first()
    assert r["neg_min"] is None and r["overlap_lo"] is None and r["overlap_pct"] == 0.0


def test_knn_with_gaps_anywhere_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(160, 3)).round(2)
    x[rng.random(x.shape) < 0.25] = np.nan
    x[:2] = [[np.nan, 5.0, np.nan], [0.0, 5.0, 1.0]]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = knn_join(df.where("id < 40"), df.where("id >= 40 or id = 0"), ["id"], ["id"], ["a", "b", "c"], 3, ["a", "b"],
                   metric="nan_euclidean", occupancy=4)
    by = {}
    for r in got.collect():
        by.setdefault(r["id"], []).append((r["nn_rank"], r["dist"]))
    donors = [0, *range(40, 160)]
    for i in range(40):
        d = []
        for j in donors:
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if both.any():
                d.append(np.sqrt(3 / both.sum() * ((x[i] - x[j])[both] ** 2).sum()))
        want = sorted(d)[:3]
        assert [v for _, v in sorted(by.get(i, []))] == pytest.approx(want)


def test_modes_in_one_pass(spark):
    from cohortspark.operators import impute as im
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (2, "b"), (None, None), (None, None), (None, None)], "n int, s string")
    assert im.modes(df, ["n", "s"]) == {"n": 1, "s": "a"}


def test_rank_sum_labels_with_ties_and_other_k(spark):
    rows = [(1, 5.0, 1.0, 9.0, 50.0, 30.0), (2, 5.0, 1.0, 9.0, 50.0, 30.0), (3, 1.0, 0.0, 1.0, 60.0, 20.0), (4, 0.0, 0.1, 2.0, 60.0, 25.0),
            (5, 0.0, 0.0, 0.0, 10.0, 20.0)]
    med = spark.createDataFrame(rows, "cluster int, lap double, log_tg_hdl double, waist_circumference double, age double, bmi double")
    lab = {r["cluster"]: r["phenotype"] for r in cl.rank_sum_labels(med).collect()}
    assert lab == {1: "SIRD", 3: "MARD", 2: "MOD", 4: "SIDD", 5: "SIDD"}
