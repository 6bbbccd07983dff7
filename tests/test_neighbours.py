"""k-nearest neighbours: exact on skewed, gappy and repeated donors, with the number of compared pairs; long vectors;
wide correlation matrices."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import correlation as co
from cohortspark.operators import impute as im
from cohortspark.operators import vector_index as vi
from cohortspark.operators.knn import build_tree, knn_join


def frame(spark, x, names="abcdefgh"):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names[:x.shape[1]]))


def brute(q, x, k, metric="nan_euclidean"):
    """{query: [(dist, donor)]} by comparing all pairs."""
    out = {}
    for i, a in q.items():
        d = []
        for j, b in enumerate(x):
            both = ~np.isnan(a) & ~np.isnan(b)
            if metric == "nan_euclidean":
                if both.any():
                    d.append((math.sqrt(len(a) / both.sum() * ((a - b)[both] ** 2).sum()), j))
            elif both.all():
                diff = np.abs(a - b)
                d.append(({"euclidean": np.sqrt((diff**2).sum()), "manhattan": diff.sum(), "chebyshev": diff.max(),
                           "minkowski": (diff**3).sum() ** (1 / 3)}[metric], j))
        out[i] = sorted(d)[:k]
    return out


def check(got, want):
    mine = {}
    for r in got:
        mine.setdefault(r["id"], []).append((r["nn_rank"], r["dist"], r["d_id"]))
    assert set(mine) == {i for i, v in want.items() if v}
    for i, v in mine.items():
        assert [d for _, d, _ in sorted(v)] == pytest.approx([d for d, _ in want[i]])
        # donors at distinct distances are the same ones; ties go by id
        assert [(round(d, 9), j) for _, d, j in sorted(v)] == [(round(d, 9), j) for d, j in want[i]]


@pytest.mark.parametrize("metric", ["nan_euclidean", "euclidean", "manhattan", "chebyshev", "minkowski"])
def test_all_metrics_with_gaps(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)).round(2)
    x[rng.random(x.shape) < 0.15] = np.nan
    df = frame(spark, x)
    got = knn_join(df.where("id % 10 = 0"), df, ["id"], ["id"], ["a", "b", "c"], 4, metric=metric, p=3.0, occupancy=6).collect()
    check(got, brute({i: x[i] for i in range(0, 400, 10)}, x, 4, metric))


def pairs_of(spark, donors, queries, feats=("a", "b"), k=5, occupancy=16):
    seen = {}
    got = knn_join(frame(spark, queries), frame(spark, donors), ["id"], ["id"], list(feats), k, metric="nan_euclidean", occupancy=occupancy,
                   visited=seen).collect()
    check(got, brute(dict(enumerate(queries)), donors, k))
    return seen["pairs"]


def test_outliers_do_not_widen_the_cells(spark):
    """One far donor costs at most 1.5 x the pairs of uniform donors; features over nine orders of magnitude, where
    the k-th distance spans many cells of the smaller one, at most 6 x."""
    rng = np.random.default_rng(5)
    uniform, queries = rng.random((4000, 2)), rng.random((60, 2))
    plain = pairs_of(spark, uniform, queries)
    assert plain < 60 * 4000 / 20
    outlier = np.vstack([uniform[:-1], [[1e6, 1e6]]])
    assert pairs_of(spark, outlier, queries) <= 1.5 * plain
    skewed = np.exp(20 * uniform - 10)
    assert pairs_of(spark, skewed, np.exp(20 * queries - 10)) <= 6 * plain


def test_donors_without_a_value_are_pruned_too(spark):
    """A third of the donors lack the first feature, a few lack two, some queries lack one: at most 1.5 x the pairs of
    donors without gaps."""
    rng = np.random.default_rng(6)
    donors, queries = rng.random((3000, 3)), rng.random((50, 3))
    plain = pairs_of(spark, donors, queries, ("a", "b", "c"))
    donors[::3, 0] = np.nan
    donors[5:1000:50, :2] = np.nan
    queries[::5, 1] = np.nan
    pairs = pairs_of(spark, donors, queries, ("a", "b", "c"))
    print("pairs", plain, pairs)
    assert pairs <= 1.5 * plain < 50 * 3000 / 3


def test_equal_donors_are_dealt_out(spark):
    """A third of the donors are one point: their cell is split by hash, and ties go by id."""
    rng = np.random.default_rng(7)
    donors = rng.random((900, 2)).round(3)
    donors[:300] = 0.5
    df = frame(spark, donors)
    placed, levels = build_tree(df, ["id"], ["a", "b"], 16, [], [])
    sizes = [r["n"] for r in levels[-1].collect()]
    assert sum(sizes) == 900 and max(sizes) <= 64 and placed.count() == 900
    got = knn_join(df.where("id in (0, 299, 400, 500)"), df, ["id"], ["id"], ["a", "b"], 5, occupancy=16).collect()
    check(got, brute({i: donors[i] for i in (0, 299, 400, 500)}, donors, 5, "euclidean"))


def test_edges(spark):
    x = np.array([[1.0, np.nan], [np.nan, 2.0], [1.0, 2.0]])
    df = frame(spark, x)
    check(knn_join(df, df, ["id"], ["id"], ["a", "b"], 9, metric="nan_euclidean", occupancy=1).collect(), brute(dict(enumerate(x)), x, 9))
    assert knn_join(df, df.limit(0), ["id"], ["id"], ["a", "b"], 2).count() == 0
    assert knn_join(df.limit(0), df, ["id"], ["id"], ["a", "b"], 2).count() == 0
    none = frame(spark, np.full((2, 2), np.nan))
    assert knn_join(none, df, ["id"], ["id"], ["a", "b"], 2, metric="nan_euclidean").count() == 0


def test_fill_of_several_targets_in_one_join(spark):
    """Every target's donors are the rows that have it, although all targets share one search."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)).round(2)
    x[rng.random(x.shape) < 0.2] = np.nan
    df = frame(spark, x)
    out = {r["id"]: r for r in im.knn_fill(df, ["id"], list("abcd"), k=3, occupancy=8).collect()}
    for i, row in enumerate(x):
        for t, c in enumerate("abcd"):
            if not np.isnan(row[t]):
                assert out[i][c] == row[t]
                continue
            have = [j for j in range(300) if not np.isnan(x[j, t])]
            near = [(d, have[j]) for d, j in brute({0: row}, x[have], 3)[0]]
            if not near:
                want = np.nanmean(x[:, t])
            elif near[0][0] == 0:
                want = np.mean([x[j, t] for d, j in near if d == 0])
            else:
                want = np.average([x[j, t] for _, j in near], weights=[1 / d for d, _ in near])
            assert out[i][c] == pytest.approx(want)


# ---------------------------------------------------------------- long vectors
def vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(x)], "id long, v array<double>, label int")


def nearest(q, x, k):
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    return [sorted((round(v, 9), j) for j, v in enumerate(row))[:k] for row in d]


def search(spark, q, x, k=5):
    seen = {}
    got = vi.vector_knn(vectors(spark, q), vectors(spark, x), ["id"], ["id"], "v", k, payload=["label"], visited=seen).collect()
    mine = {}
    for r in got:
        assert r["d_label"] == r["d_id"] % 7
        mine.setdefault(r["id"], []).append((r["nn_rank"], round(r["dist"], 9), r["d_id"]))
    want = nearest(q, x, k)
    assert len(mine) == len(q)
    for i, v in mine.items():
        assert [t[1:] for t in sorted(v)] == want[i]
    return seen


def test_clustered_vectors_visit_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK", 32)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 24)) * 3
    x = centres[rng.integers(30, size=3000)] + 0.3 * rng.normal(size=(3000, 24))
    x[100:400] = x[100]                       # a tenth of the donors is one vector
    seen = search(spark, x[::60] + 0.01, x)
    assert seen["all_pairs"] == 50 * 3000
    assert seen["pairs"] < 0.25 * seen["all_pairs"] and seen["compared"] < 0.2 * seen["all_pairs"]


def test_random_vectors_spare_full_distances(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seen = search(spark, rng.normal(size=(40, 64)) / 8, x)
    assert seen["compared"] < 0.5 * seen["all_pairs"]


def test_odd_vectors(spark):
    rows = [(1, [0.0, 1.0], 0), (2, None, 0), (3, [None, 1.0], 0), (4, [float("nan"), 0.0], 0), (5, [1.0], 0), (6, [3.0, 1.0], 0), (7, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    got = sorted((r["id"], r["nn_rank"], r["d_id"], r["dist"]) for r in vi.vector_knn(df, df, ["id"], ["id"], "v", 9).collect())
    assert got == [(i, n, j, d) for i, near in ((1, [(1, 0.0), (7, 0.0), (6, 3.0)]), (6, [(6, 0.0), (1, 3.0), (7, 3.0)]), (7, [(1, 0.0), (7, 0.0), (6, 3.0)]))
                   for n, (j, d) in enumerate(near, 1)]
    assert vi.vector_knn(df.limit(0), df, ["id"], ["id"], "v", 2).count() == 0
    assert vi.vector_knn(df, df.limit(0), ["id"], ["id"], "v", 2).count() == 0


# ---------------------------------------------------------------- wide correlation
def test_two_hundred_columns_equal_pairwise_corr(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 200)) @ np.diag(10.0 ** rng.integers(-1, 6, 200)) + 10.0 ** rng.integers(0, 5, 200)
    x[:, 1] = 2 * x[:, 0] + 1
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[2:, 9] = 3.3, np.nan
    cols = [f"c{i}" for i in range(200)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols)).repartition(3)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if i % 2 else F.col(c) for i, c in enumerate(cols)])   # NULLs and NaNs
    got = {(r["col_a"], r["col_b"]): r["r"] for r in co.corr_pairs(df, cols).collect()}
    assert len(got) == 200 * 199 // 2
    want = pd.DataFrame(x, columns=cols).corr()
    for (a, b), r in got.items():
        w = want.loc[a, b]
        if "c7" in (a, b) or "c9" in (a, b):
            assert r is None or abs(abs(r) - 1) < 1e-9       # no variance, or two rows
        else:
            assert r == pytest.approx(w, abs=1e-8)
    few = {(r["col_a"], r["col_b"]): r["r"] for r in co.corr_pairs(df.select(*[F.nanvl(c, F.lit(None)).alias(c) for c in cols[10:18]]), cols[10:18]).collect()}
    assert all(got[k] == pytest.approx(v, abs=1e-8) for k, v in few.items())
    assert co.gram_pairs(df.limit(0), cols[:3]).where("r IS NOT NULL").count() == 0
