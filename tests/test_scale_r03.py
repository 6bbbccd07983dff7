"""Fits and neighbour searches that must not repeat passes or pairs."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator

from cohortspark.operators import cluster as cl
from cohortspark.operators import features as fe
from cohortspark.operators import impute as im
from cohortspark.operators import ledger as lg
from cohortspark.operators import models as mo
from cohortspark.operators import tuning as tu
from cohortspark.operators.knn import knn_join


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(float)
    rows = [(i, *map(float, v), float(t), i % 2) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, label double, fold int").cache()


@pytest.fixture
def scale_passes(monkeypatch):
    """The columns of every pass over the rows for means and stds."""
    passes, plain = [], fe.fit_standard

    def counted(df, cols):
        passes.append(list(cols))
        return plain(df, cols)

    monkeypatch.setattr(fe, "fit_standard", counted)
    monkeypatch.setattr(tu, "fit_standard", counted, raising=False)
    return passes


def _pipe(cols):
    transformer, est = fe.ColumnTransformer(cols), mo.make_estimator("lr", "label", maxIter=5)
    return Pipeline(stages=[transformer, est]), transformer, est


def test_sweep_scales_each_fold_once(toy, scale_passes):
    sets = {"one": ["a"], "two": ["a", "b"], "three": ["a", "b", "c"]}
    tu.feature_set_sweep(toy, sets, lambda: mo.make_estimator("lr", "label", maxIter=5), "fold").collect()
    assert scale_passes == [["a", "b", "c"]] * 2


def test_stored_predictions_scale_each_fold_once(toy, scale_passes, tmp_path):
    models = {n: _pipe(list(n))[0] for n in ("a", "ab", "abc")}
    pred = lg.store_cv(toy, models, "fold", "label", ["id"], str(tmp_path / "p"))
    assert sorted(map(sorted, scale_passes)) == [["a", "b", "c"]] * 2 and pred.count() == 720
    # the shared scales are those of the model's own fold
    alone = {r["id"]: r["score"] for r in tu.out_of_fold(toy, models["ab"], "fold", ["id"]).collect()}
    assert {r["id"]: pytest.approx(r["score"], abs=1e-9) for r in pred.where("model = 'ab'").collect()} == alone


def test_search_keeps_no_copy_of_the_folds(spark, toy, monkeypatch):
    from pyspark.sql import DataFrame
    kept = []
    monkeypatch.setattr(DataFrame, "cache", lambda self: kept.append(self) or self)
    pipe, transformer, est = _pipe(["a"])
    maps = [{transformer.numericCols: ["a"], est.regParam: 0.0}, {transformer.numericCols: ["b", "c"], est.regParam: 0.1}]
    model, trials = tu.cross_validate(toy, pipe, maps, MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"), "fold")
    assert not kept and trials.where("is_best").first()["trial"] == 0
    assert list(model.bestModel.stages[0].columns()) == ["a"] and len(model.avgMetrics) == 2
    with pytest.raises(ValueError, match="folds"):
        tu.cross_validate(toy.withColumn("fold", toy["fold"] + 1), pipe, maps, MulticlassClassificationEvaluator(labelCol="label"), "fold")


def test_copies_of_donors_cost_no_more_pairs(spark):
    rng = np.random.default_rng(3)
    points, pairs, found = rng.random((60, 2)).tolist(), {}, {}
    for copies in (1, 40):
        donors = spark.createDataFrame([(j * 60 + i, *p) for j in range(copies) for i, p in enumerate(points)], "id int, a double, b double")
        visited = {}
        got = knn_join(donors.where("id < 60"), donors, ["id"], ["id"], ["a", "b"], 3, occupancy=8, visited=visited)
        found[copies] = {(r["id"], r["nn_rank"]): (r["d_id"], r["dist"]) for r in got.collect()}
        pairs[copies] = visited["pairs"]
    # the least three ids of 40 equal donors at distance 0
    assert all(found[40][i, k + 1] == (k * 60 + i, 0.0) for i in range(60) for k in range(3))
    assert pairs[40] <= 4 * pairs[1]


def test_equal_donors_with_different_targets(spark):
    """Equal features, but only some donors have the value: those count for it."""
    rows = [(i, 1.0, None if i < 6 else float(i), 2.0) for i in range(12)] + [(99, 1.0, None, 2.0)]
    df = spark.createDataFrame(rows, "id int, a double, v double, w double")
    out = {r["id"]: r["v"] for r in im.knn_fill(df, ["id"], ["a", "w"], k=3, targets=["v"]).collect()}
    assert out[99] == out[0] == pytest.approx((6 + 7 + 8) / 3) and out[11] == 11.0


def test_k_sweep_runs_several_k_at_once(toy):
    x = fe.assemble(toy, ["a", "b", "c"])
    at_once = cl.k_sweep(x, "features", [2, 3, 4], [1, 2], 20, parallelism=3).collect()
    one_by_one = cl.k_sweep(x, "features", [2, 3, 4], [1, 2], 20, parallelism=1).collect()
    assert [tuple(r) for r in at_once] == [pytest.approx(tuple(r)) for r in one_by_one]
    assert [r["k"] for r in at_once] == [2, 3, 4]
