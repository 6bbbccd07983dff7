"""The registered searches and cross-validations on the smallest tables."""

import json

import pytest

from cohortspark.plans.registry import load_all

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return load_all()[name].build(spark, SF).collect()


def test_joint_search(spark):
    rows = run(spark, "joint_search")
    assert {r["search"] for r in rows} == {"drawn", "grid"} and len(rows) == 10
    chosen = [r for r in rows if r["chosen"]]
    assert len(chosen) == 1 and chosen[0]["metric_mean"] == max(r["metric_mean"] for r in rows)
    assert len(json.loads(chosen[0]["final_coefficients"])) == chosen[0]["n_features"]
    drawn = [r for r in rows if r["search"] == "drawn"]
    assert len({r["feature_set"] for r in drawn}) > 1 and len({r["params"] for r in drawn}) == 6


def test_forest_search(spark):
    rows = run(spark, "forest_search")
    assert len(rows) == 4 and all(r["n_folds"] == 3 and 0 <= r["macro_f1_mean"] <= 1 for r in rows)
    best = [r for r in rows if r["is_best"]]
    assert len(best) == 1 and best[0]["weighted_f1_mean"] == max(r["weighted_f1_mean"] for r in rows)


def test_model_cv(spark):
    rows = {(r["model"], r["metric"]): r for r in run(spark, "model_cv")}
    assert len(rows) == 10 and {m for m, _ in rows} == {"lr_binary", "rf"}
    for r in rows.values():
        assert 0 <= r["cv_mean"] <= 1 and r["cv_std"] >= 0 and not r["too_good"]
        assert r["status"] == ("Good" if abs(r["test"] - r["cv_mean"]) <= 2 * r["cv_std"] + 1e-5 else "Check") or r["cv_std"] < 1e-5


def test_boosted_queries(spark):
    rows = run(spark, "gbt_multiclass")
    assert len(rows) == 10 and all(0 <= r["auc"] <= 1 for r in rows)
    one = run(spark, "gbt_positive_weight")[0]
    assert one["positive_weight"] > 1 and 1 <= one["n_trees"] <= 15 and 0 <= one["roc_auc"] <= 1


def test_elimination_by_slices_equals_refits(spark):
    """Ranks equal those of fits that scale the remaining columns anew."""
    from pyspark.ml import Pipeline
    from pyspark.sql import functions as F
    from cohortspark.operators import models as mo
    from cohortspark.operators import tuning as tu
    from cohortspark.operators.features import ColumnTransformer
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    x = li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("double").alias("label")).cache()
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    got = {r["feature"]: (r["rfe_rank"], r["abs_coef_at_drop"]) for r in tu.recursive_elimination(x, feats, lambda: mo.make_estimator("lr", "label")).collect()}
    left, rank = list(feats), len(feats)
    while left:
        m = Pipeline(stages=[ColumnTransformer(left), mo.make_estimator("lr", "label")]).fit(x)
        size = dict(zip(left, abs(m.stages[-1].coefficientMatrix.toArray()[0])))
        worst = min(left, key=lambda f: (size[f], f))
        assert got[worst][0] == rank and got[worst][1] == pytest.approx(size[worst], abs=1e-6)
        left.remove(worst)
        rank -= 1
