"""Whitening: every column against numpy over the whole table, slabs and blocks of other sizes, odd rows."""

import numpy as np
import pytest

from cohortspark.llm import whitening as W
from cohortspark.llm.queries import op11_whitening

SCHEMA = "vec_id bigint, embedding array<double>, label int, x string, component string"


def brute(vectors, components=W.COMPONENTS):
    """n, deviations, |whitened| and explained of a list of finite vectors, in plain numpy and Python integers."""
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), [int(v) for v in fit.sum(axis=0)]
    dev = [sum((n * int(a) - t) ** 2 for a, t in zip(row, s)) for row in x]
    a = fit - fit.mean(axis=0)
    e, u = np.linalg.eigh(a.T @ a / n)
    order = [j for j in np.argsort(e)[::-1][:components] if e[j] > 1e-12 * e.max()]
    z = (x - fit.mean(axis=0)) @ u[:, order] / np.sqrt(e[order])
    return n, dev, z, e[order] / e.sum()


def compare(got, ids, vectors):
    n, dev, z, explained = brute(vectors)
    rows = {}
    for r in got:
        rows.setdefault((r.vec_id, r.deviation), []).append(r)
    assert len(got) == len(ids) * z.shape[1]
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    signs = {}
    for i, d, row in zip(ids, dev, z):
        mine = sorted(rows[(i, d)], key=lambda r: r.component)
        copies = len(mine) // len(row)
        for r in mine:
            assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
            want = row[r.component - 1]
            if abs(want) > 1e-6:
                signs.setdefault(r.component, np.sign(r.whitened * want))
                assert r.whitened == pytest.approx(signs[r.component] * want, abs=1e-7)
            else:
                assert abs(r.whitened) < 2e-6
        assert copies >= 1


def test_query_equals_numpy(spark):
    sf = "/root/testdata/sf0.01"
    pd = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    compare(op11_whitening(spark, sf).collect(), pd.vec_id.tolist(), pd.embedding.tolist())


def test_slabs_and_small_blocks(spark, monkeypatch):
    """More blocks than a slab, short last blocks and several tasks give the same rows."""
    monkeypatch.setattr(W, "SLAB_BLOCKS", 3)
    monkeypatch.setattr(W, "BLOCK_VALUES", 6 * 16)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(230, 6)) @ rng.normal(size=(6, 6))
    vectors[50:120] = vectors[0]                      # one vector holds a third of the rows
    df = spark.createDataFrame([(i, v.tolist(), 0, "", "") for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    compare(W.whiten(df).collect(), list(range(230)), vectors.tolist())


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 4)))]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan"), 1.0, 1.0, 1.0]), (103, [float("inf"), 0.0, 0.0, 0.0]),
           (104, []), (105, [1.0, 2.0]), (None, good[0][1]), (3, good[3][1]), (3, good[3][1])]
    df = spark.createDataFrame([(i, v, 0, None, None) for i, v in good + odd], SCHEMA)
    kept = good + odd[-3:]
    compare(W.whiten(df).collect(), [i for i, _ in kept], [v for _, v in kept])


def test_empty_single_and_flat(spark):
    def of(vectors):
        return W.whiten(spark.createDataFrame([(i, v, 0, "", "") for i, v in enumerate(vectors)], SCHEMA)).collect()
    assert of([]) == [] and of([None, []]) == []
    assert of([[1.0, 2.0]] * 5) == []                 # one distinct vector: no component has an eigenvalue
    line = of([[float(i), 2.0 * i, 5.0] for i in range(30)])
    assert {r.component for r in line} == {1}         # rank one
    assert line[0].explained == pytest.approx(1.0)


def test_deviation_is_exact_beyond_longs():
    n, total = 10**7, [3 * 10**13 + 1, -7]
    m = np.array([[3_000_000, 0], [10**9, -(10**9)]], dtype=np.int64)
    want = [sum((n * int(v) - t) ** 2 for v, t in zip(row, total)) for row in m]
    assert W.deviations(m, n, total) == want and max(want) > 2**63
    assert W.deviations(m[:1], 3, [9_000_000, 1]) == [(3 * 3_000_000 - 9_000_000) ** 2 + 1]


def test_huge_entries_saturate(spark):
    rows = [[1e300, 1.0], [-1e300, 2.0], [0.5, 3.0]]
    got = W.whiten(spark.createDataFrame([(i, v, 0, "", "") for i, v in enumerate(rows)], SCHEMA)).collect()
    assert len(got) and all(np.isfinite(r.whitened) for r in got)
