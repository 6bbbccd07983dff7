"""Invariants of fitted models, searches and clusterings (no SQL oracle can express a fit)."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortspark.operators import cluster as cl
from cohortspark.operators import features as fe
from cohortspark.operators import impute as im
from cohortspark.operators import models as mo
from cohortspark.operators import tuning as tu
from cohortspark.plans.registry import load_all

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return load_all()[name].build(spark, SF)


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) * [1.0, 1000.0, 0.01]
    y = (x[:, 0] * 2 + x[:, 1] / 1000 + rng.normal(size=400) * 0.3 > 0).astype(float)
    s = rng.choice(["p", "q", "r"], 400)
    rows = [(float(a), float(b), float(c), str(k), float(t), i % 3) for i, ((a, b, c), k, t) in enumerate(zip(x, s, y))]
    return spark.createDataFrame(rows, "a double, b double, c double, s string, label double, fold int").cache()


def test_column_transformer_equals_numpy(spark, toy):
    m = fe.ColumnTransformer(["a", "b"], ["s"]).fit(toy)
    pdf = toy.toPandas()
    got = np.array([r[0] for r in m.transform(toy).select(vector_to_array("features")).collect()])
    want = np.column_stack([(pdf.a - pdf.a.mean()) / pdf.a.std(ddof=0), (pdf.b - pdf.b.mean()) / pdf.b.std(ddof=0), pdf.s == "q", pdf.s == "r"])
    assert np.allclose(got, want.astype(float))
    odd = spark.createDataFrame([(None, 1.0, "unseen"), (2.0, None, None)], "a double, b double, s string")
    v = [r[0] for r in m.transform(odd).select(vector_to_array("features")).collect()]
    assert v[0][0] == 0.0 and v[0][2:] == [0.0, 0.0] and v[1][1] == 0.0 and v[1][2:] == [0.0, 0.0]


def test_logistic_regression_equals_newton(toy):
    """L2-penalised logistic regression against a hand-written Newton iteration."""
    pipe = Pipeline(stages=[fe.ColumnTransformer(["a", "b", "c"]),
                            mo.make_estimator("lr", "label", regParam=mo.sklearn_c_to_reg(0.5, 400), maxIter=200, tol=1e-10)]).fit(toy)
    x = np.array([r[0] for r in pipe.transform(toy).select(vector_to_array("features")).collect()])
    y = np.array([r[0] for r in toy.select("label").collect()])
    a, w = np.column_stack([x, np.ones(400)]), np.zeros(4)
    pen = np.diag([1 / 0.5, 1 / 0.5, 1 / 0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + pen, a.T @ (p - y) + pen @ w)
    lr = pipe.stages[-1]
    assert np.allclose(lr.coefficients.toArray(), w[:3], atol=1e-4) and abs(lr.intercept - w[3]) < 1e-4


def test_out_of_fold_and_pooled_metrics(toy):
    pipe = Pipeline(stages=[fe.ColumnTransformer(["a", "b", "c"], ["s"]), mo.make_estimator("lr", "label", maxIter=20)])
    pred = tu.out_of_fold(toy, pipe, "fold", ["label", "a"]).cache()
    assert pred.count() == 400 and pred.where("score < 0 or score > 1").count() == 0
    pdf = pred.toPandas()
    m = tu.pooled_metrics(pred, "label")
    assert m["accuracy"] == pytest.approx((pdf.label == pdf.prediction).mean())
    assert m["recall"] == pytest.approx(pdf.prediction[pdf.label == 1].mean())
    pos, neg = pdf.score[pdf.label == 1].to_numpy(), pdf.score[pdf.label == 0].to_numpy()
    assert m["auc"] == pytest.approx(((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()))
    assert m["accuracy"] > 0.85 and 0.7 < m["kappa"] <= 1


def test_elimination_ranks_by_importance_not_by_unit(toy):
    r = {x["feature"]: x["rfe_rank"] for x in tu.recursive_elimination(toy, ["a", "b", "c"], lambda: mo.make_estimator("lr", "label")).collect()}
    assert r == {"a": 1, "b": 2, "c": 3}
    assert tu.rank_prefixes(["a", "b"]) == {"top 1": ["a"], "top 2": ["a", "b"]}


def test_search_flags_its_best_trial_and_keeps_exact_parameters(toy):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    est = mo.make_estimator("lr", "label", maxIter=5)
    maps = tu.sample_param_maps(est, {"regParam": ("loguniform", 1e-14, 1e-13), "elasticNetParam": ("uniform", 0, 1)}, 3)
    pipe = Pipeline(stages=[fe.ColumnTransformer(["a", "c"]), est])
    model, trials = tu.cross_validate(toy, pipe, maps, MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"), "fold")
    rows = trials.collect()
    best = [r for r in rows if r["is_best"]]
    assert len(best) == 1 and best[0]["metric_mean"] == max(r["metric_mean"] for r in rows)
    for r, pm in zip(sorted(rows, key=lambda r: r["trial"]), maps):
        assert json.loads(r["params"]) == {p.name: v for p, v in pm.items()}
    assert model.bestModel.stages[-1].getRegParam() == json.loads(best[0]["params"])["regParam"]
    both = tu.better_search({"one": trials, "two": trials}).collect()
    assert [r["chosen"] for r in sorted(both, key=lambda r: r["search"])] == [True, False]


def test_nested_sets_and_top_correlated(toy):
    sets = fe.nested_feature_sets(fe.BASE_SET, ["vai", "lap"], 3)
    names = list(sets)
    assert len(names) == 7 and all(set(sets[a]) <= set(sets[b]) for a, b in zip(names, names[1:]))
    assert fe.top_correlated(toy, ["a", "b", "c"], "label", 2) == ["a", "b"]


def test_lr_binary_query(spark):
    rows = run(spark, "lr_binary").collect()
    assert rows and all(0 <= r["p1"] <= 1 and r["prediction"] == float(r["p1"] > 0.5) for r in rows if abs(r["p1"] - 0.5) > 1e-5)


def test_forest_queries(spark):
    imp = run(spark, "rf_importance").collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1, abs=1e-6)
    assert sorted(r["rank"] for r in imp) == list(range(1, len(imp) + 1))
    votes = run(spark, "tree_votes").first()
    assert 0.5 < votes["agreement"] <= 1 and votes["n_trees"] == 15
    shape = run(spark, "decision_tree_shape").collect()
    assert all(0 < r["depth"] <= 6 and r["num_nodes"] < 2**7 for r in shape)


def test_model_reports_are_probabilities(spark):
    zoo = run(spark, "model_zoo").collect()
    assert {r["model"] for r in zoo} == {"lr_multinomial", "gbt_ovr", "decision_tree", "naive_bayes", "linear_svc_ovr", "mlp"}
    assert all(0 <= r[c] <= 1 for r in zoo for c in ("precision", "recall", "f1"))
    g = run(spark, "gbt_binary").first()
    assert all(0 <= g[c] <= 1 for c in ("accuracy", "precision", "recall", "f1", "auc"))
    coef = run(spark, "coef_rank").collect()
    assert all(r["abs_coef"] == abs(r["coef"]) for r in coef) and len({r["class_name"] for r in coef}) == 3


def test_search_queries(spark):
    t = run(spark, "random_search").collect()
    assert [r["metric_mean"] for r in t if r["is_best"]] == [max(r["metric_mean"] for r in t)]
    g = run(spark, "grid_logo").collect()
    assert sum(r["chosen"] for r in g) == 1
    assert [r["metric_mean"] for r in g if r["chosen"]] == [max(r["metric_mean"] for r in g)]


@pytest.mark.parametrize("name", ["feature_set_sweep", "prefix_sweep"])
def test_sweeps(spark, name):
    s = sorted(run(spark, name).collect(), key=lambda r: r["position"])
    assert all(r["gain_over_first"] == pytest.approx(r["accuracy"] - s[0]["accuracy"], abs=2e-6) for r in s)
    assert [r["accuracy"] for r in s if r["is_best"]] == [max(r["accuracy"] for r in s)]
    assert all(a["n_features"] < b["n_features"] for a, b in zip(s, s[1:]))


def test_kmeans_queries(spark):
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(c, 0.2, size=(50, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(
        spark.createDataFrame([tuple(map(float, p)) for p in pts], "x double, y double")).cache()
    sweep = {r["k"]: r for r in cl.k_sweep(df, "features", [2, 3, 4, 5], seeds=[1, 2, 3]).collect()}
    w = [sweep[k]["wcss"] for k in (2, 3, 4, 5)]
    assert all(a >= b for a, b in zip(w, w[1:])) and max(sweep, key=lambda k: sweep[k]["silhouette"]) == 3
    sizes = run(spark, "kmeans_sizes").collect()
    n = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert sum(r["n"] for r in sizes) == n


def test_model_fill_keeps_every_row(spark):
    rows = [(i, float(i % 7), float(i % 3), None if i % 5 == 0 else ("u" if i % 3 == 0 else "v")) for i in range(200)]
    df = spark.createDataFrame(rows + [(999, None, 1.0, None)], "id int, p double, q double, seg string")
    donors = spark.createDataFrame([(float(i % 7), float(i % 3), "u" if i % 3 == 0 else "v") for i in range(300)], "p double, q double, seg string")
    filled, _ = im.model_fill(df, donors, "seg", ["p", "q"], num_trees=10, max_depth=4)
    got = {r["id"]: r["seg"] for r in filled.collect()}
    assert set(got) == {r[0] for r in rows} | {999} and None not in got.values()
    assert all(got[i] == ("u" if i % 3 == 0 else "v") for i in range(200))


def _gappy_donors(spark):
    rows = [(i, float(i % 7), float(i % 3), "u" if i % 3 == 0 else "v") for i in range(300)]
    odd = [(900, None, 1.0, "u"), (901, float("nan"), 2.0, "u"), (902, 3.0, None, "v"), (903, 3.0, 1.0, None)]
    return spark.createDataFrame(rows + odd, "id int, p double, q double, seg string")


def test_model_fill_donors_without_a_feature(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0, None), (2, 2.0, 1.0, None), (3, float("nan"), 1.0, None), (4, None, 0.0, None)],
                               "id int, p double, q double, seg string")
    filled, _ = im.model_fill(df, _gappy_donors(spark), "seg", ["p", "q"], num_trees=10, max_depth=4)
    got = {r["id"]: r["seg"] for r in filled.collect()}
    assert got[1] == "u" and got[2] == "v" and set(got) == {1, 2, 3, 4} and None not in got.values()


def test_fill_report_donors_without_a_feature(spark):
    donors = _gappy_donors(spark)
    r = im.fill_report(donors, donors.where("id < 20"), F.col("id") < 10, "seg", ["p", "q"], ["id"], k=2, num_trees=5, max_depth=3).collect()
    assert [x["value"] for x in r if x["part"] == "accuracy"] == [1.0]


def test_t_tail_equals_numeric_integration(spark):
    p = run(spark, "t_test_pvalue").collect()
    assert p and all(0 <= r["p_value"] <= 1 for r in p)


def test_model_fill_report(spark):
    r = run(spark, "model_fill_report").collect()
    by = {p: sum(x["value"] for x in r if x["part"] == p) for p in ("importance", "share")}
    assert by["importance"] == pytest.approx(1, abs=1e-5) and by["share"] == pytest.approx(1, abs=1e-5)
    assert [0 <= x["value"] <= 1 for x in r if x["part"] == "accuracy"] == [True]
