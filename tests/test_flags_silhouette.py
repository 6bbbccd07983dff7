"""Euclidean silhouettes against all pairs, counts that come with a write, the parameterised source, the advice join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import cluster as cl
from cohortspark.operators import features as fe
from cohortspark.operators import profile as pf
from cohortspark.sources import has_flag, load_source, write_flagged, write_table


def all_pairs(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][c == o].mean() for o in set(c) if o != c[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.array(out)


def silhouettes(spark, x, c, **options):
    df = spark.createDataFrame([(i, *map(float, r), str(k)) for i, (r, k) in enumerate(zip(x, c))], "id long, u double, v double, cluster string")
    return {r["id"]: r for r in cl.euclid_silhouettes(df.repartition(3), ["id"], ["u", "v"], **options).collect()}


def blobs(n, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.choice(4, n, p=[0.55, 0.25, 0.15, 0.05])
    return rng.normal(size=(n, 2)) + np.array([[0, 0], [3, 0], [0, 4], [5, 5]])[c], c


def test_small_clusters_are_exact(spark):
    x, c = blobs(200)
    x, c = np.vstack([x, [[9.0, 9.0]], x[:3]]), np.append(c, [7, c[0], c[1], c[2]])     # a singleton and repeated points
    got, want = silhouettes(spark, x, c), all_pairs(x, c)
    assert len(got) == len(x)
    assert [got[i]["silhouette"] for i in range(len(x))] == pytest.approx(want.tolist(), abs=1e-9)
    assert all(r["error"] == 0 for r in got.values())


def test_sampled_clusters_stay_within_the_bound(spark):
    x, c = blobs(2000, 2)
    got, want = silhouettes(spark, x, c, partners=60), all_pairs(x, c)
    off = np.array([abs(got[i]["silhouette"] - want[i]) for i in range(len(x))])
    bound = np.array([got[i]["error"] for i in range(len(x))])
    assert (off <= bound).mean() > 0.98 and 0 < bound.mean() < 0.35 and off.mean() < 0.06
    # one sample per cluster and seed, whatever the partitioning
    again = silhouettes(spark, x, c, partners=60)
    assert all(again[i] == got[i] for i in got)


def test_one_cluster_gaps_and_empty(spark):
    x, c = blobs(30)
    assert all(r["silhouette"] is None and r["a"] > 0 for r in silhouettes(spark, x, np.zeros(30, int)).values())
    df = spark.createDataFrame([(1, 0.0, "a"), (2, None, "a"), (3, 1.0, None), (4, 4.0, "b"), (5, 2.0, "a")], "id long, u double, cluster string")
    got = {r["id"]: r["silhouette"] for r in cl.euclid_silhouettes(df, ["id"], ["u"]).collect()}
    assert got == {1: pytest.approx((4 - 2) / 4), 5: 0.0, 4: 0.0}
    assert cl.euclid_silhouettes(df.limit(0), ["id"], ["u"]).count() == 0


def test_flags_come_with_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, "x"), (3, 9.0, "y"), (4, None, None)], "id int, v double, s string")
    flags = {"no v": F.col("v").isNull(), "no s": F.col("s").isNull(), "high": F.col("v") > 5}
    rows, counts = write_flagged(df, flags, str(tmp_path / "t"))
    assert {r["flag"]: (r["n"], r["n_rows"]) for r in counts.collect()} == {"no v": (2, 4), "no s": (2, 4), "high": (1, 4)}
    assert [r["id"] for r in rows.where(~has_flag(flags, "no v", "no s")).collect()] == [3]
    # the counts read nothing but the mask of the written files
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("ReadSchema: struct<__flags:bigint>") > 0
    _, none = write_flagged(df.limit(0), flags, str(tmp_path / "e"))
    assert {r["n"] for r in none.collect()} == {0}


def test_source_by_suffix_and_without_diagnostic_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 7.5, "Diabetic"), (2, 5.0, "Normal"), (3, None, None)], "age int, hba1c double, status string")
    path = write_table(df.coalesce(1), str(tmp_path / "c.csv"), "csv")
    got = load_source(spark, path, ["age", "hba1c"], "status", "Diabetic", diagnostic=["hba1c"], schema=df.schema)
    assert got.columns == ["age", "label"] and sorted(map(tuple, got.collect())) == [(1, 1), (2, 0), (3, 0)]
    every = load_source(spark, df, ["age", "hba1c"], "status", "Diabetic", diagnostic=["hba1c"], exclude_diagnostic=False)
    assert every.columns == ["age", "hba1c", "label"]
    parquet = write_table(df, str(tmp_path / "p.parquet"))
    assert load_source(spark, parquet, ["hba1c"], "status").columns == ["hba1c", "label"]


def test_feature_report_and_advice(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True), (2, None, "a", False), (3, 2.0, None, None)], "id int, v double, s string, b boolean")
    assert fe.feature_columns(df, ["id"]) == (["v"], ["s"])
    got = {r["column_name"]: tuple(r)[1:] for r in pf.feature_report(df, ["v"], ["s"]).collect()}
    assert got == {"v": ("numeric", 2, 1, 1), "s": ("string", 2, 1, 1)}
    labels = spark.createDataFrame([("SIRD", 3), ("other", 1), (None, 2)], "phenotype string, n int")
    out = {r["phenotype"]: r for r in cl.with_advice(labels, cl.advice_table(spark)).collect()}
    assert out["SIRD"]["key_features"].startswith("Highest LAP") and out["other"]["recommendations"] is None and out[None]["n"] == 2
