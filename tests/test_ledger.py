"""Searches over feature sets, the trial ledger, stored predictions: against plain counts, resumed and saved."""

import json

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortspark.operators import features as fe
from cohortspark.operators import ledger as lg
from cohortspark.operators import models as mo
from cohortspark.operators import split as sp
from cohortspark.operators import tuning as tu


@pytest.fixture(scope="module")
def toy(spark):
    """Three classes (label3), a binary label that ``a`` decides and ``noise`` does not, folds and a test flag."""
    rng = np.random.default_rng(8)
    a, b, noise = rng.normal(size=(3, 500))
    y3 = np.digitize(a + 0.3 * rng.normal(size=500), [-0.6, 0.9]).astype(float)
    rows = [(i, float(a[i]), float(b[i]), float(noise[i]), float(y3[i]), float(a[i] + 0.2 * b[i] > 0.4), i % 3, i % 5 == 4) for i in range(500)]
    return spark.createDataFrame(rows, "id bigint, a double, b double, noise double, label3 double, label double, fold int, held boolean").cache()


def test_a_trial_changes_the_columns(toy):
    """TU4: feature set, C and l1_ratio in one space under CrossValidator; the best model has its trial's exact parameters."""
    sets = {"noise": ["noise"], "signal": ["a", "b"], "all": ["a", "b", "noise"]}
    ct, est = fe.ColumnTransformer(), mo.make_estimator("lr", "label", weight="weight", maxIter=10)
    pipe = Pipeline(stages=[ct, mo.BalancedWeights(), est])
    maps = tu.joint_param_maps(ct, est, sets, {"regParam": ("loguniform", 1e-4, 1e-1), "elasticNetParam": ("uniform", 0, 1)}, 8)
    assert {tuple(pm[ct.numericCols]) for pm in maps} == {tuple(v) for v in sets.values()}
    model, trials = tu.cross_validate(toy, pipe, maps, MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"), "fold")
    rows = tu.name_sets(trials, maps, ct, sets).collect()
    assert len(rows) == 8 and all(r["n_features"] == len(sets[r["feature_set"]]) for r in rows)
    best = [r for r in rows if r["is_best"]][0]
    assert best["feature_set"] != "noise" and best["metric_mean"] > 0.9
    assert max(r["metric_mean"] for r in rows if r["feature_set"] == "noise") < 0.7
    stages = model.bestModel.stages
    assert list(stages[0].columns()) == sets[best["feature_set"]]
    assert stages[-1].getRegParam() == json.loads(best["params"])["regParam"]
    # the folds were fitted with those columns too: a trial's mean equals a hand-made cross-validation
    pm = maps[best["trial"]]
    accs = []
    for f in range(3):
        m = pipe.copy(pm).fit(toy.where(F.col("fold") != f)).transform(toy.where(F.col("fold") == f))
        accs.append(m.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
    assert best["metric_mean"] == pytest.approx(np.mean(accs))


def test_transformer_and_weights_are_saved(spark, toy, tmp_path):
    pipe = Pipeline(stages=[fe.ColumnTransformer(["a", "b"]), mo.BalancedWeights(), mo.make_estimator("lr", "label", weight="weight", maxIter=5)])
    fitted = pipe.fit(toy)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    back = PipelineModel.load(str(tmp_path / "model"))
    want = fitted.transform(toy).select("id", vector_to_array("probability")[1].alias("p"), "weight").orderBy("id").collect()
    assert back.transform(toy).select("id", vector_to_array("probability")[1].alias("p"), "weight").orderBy("id").collect() == want
    pipe.write().overwrite().save(str(tmp_path / "pipe"))
    assert Pipeline.load(str(tmp_path / "pipe")).getStages()[0].getOrDefault("numericCols") == ["a", "b"]


def test_weights(spark):
    df = spark.createDataFrame([(1.0,)] * 2 + [(0.0,)] * 6 + [(None,)], "label double")
    w = {r[0]: r[1] for r in mo.BalancedWeights().fit(df).transform(df).distinct().collect()}
    assert w == {1.0: 2.0, 0.0: pytest.approx(8 / 12), None: 1.0}
    w = {r[0]: r[1] for r in mo.BalancedWeights(scheme="positive").fit(df).transform(df).distinct().collect()}
    assert w == {1.0: 3.0, 0.0: 1.0, None: 1.0}


def test_levels_are_bounded(spark):
    df = spark.createDataFrame([(f"k{i}", i % 2 == 0) for i in range(30)] + [(None, None)], "s string, b boolean")
    assert fe.fit_levels(df, ["s", "b"], 30) == {"s": sorted(f"k{i}" for i in range(30)), "b": [False, True]}
    with pytest.raises(ValueError):
        fe.fit_levels(df, ["s"], 29)
    assert fe.fit_levels(df.limit(0), ["s"]) == {"s": []}


class Counting(Pipeline):
    """Counts its fits, and fails from a given one on."""

    fits, fails_from = 0, 10**9

    def _fit(self, dataset):
        type(self).fits += 1
        if self.fits >= self.fails_from:
            raise RuntimeError("stopped")
        return super()._fit(dataset)


def sk_scores(y, p):
    """Accuracy, macro and weighted F1 over the classes that occur, by hand."""
    classes = sorted(set(y) | set(p))
    f1, support = [], []
    for c in classes:
        tp, n, k = ((y == c) & (p == c)).sum(), (y == c).sum(), (p == c).sum()
        f1.append(2 * tp / (n + k) if n + k else 0.0)
        support.append(n)
    return (y == p).mean(), np.mean(f1), np.average(f1, weights=support)


def test_a_stopped_search_resumes(toy, tmp_path):
    """The first run fails in its fifth fit; the second one makes only the missing fits, a third one none."""
    x = fe.assemble(toy, ["a", "b", "noise"])
    est = mo.make_estimator("dt", "label3", weight="weight")
    pipe, folder = Counting(stages=[mo.BalancedWeights("label3"), est]), str(tmp_path / "ledger")
    maps = [{est.maxDepth: d} for d in (1, 2, 4)]
    Counting.fits, Counting.fails_from = 0, 5
    with pytest.raises(RuntimeError):
        lg.run_search(x, pipe, maps, "fold", "label3", folder, "trees", parallelism=1)
    Counting.fits, Counting.fails_from = 0, 10**9
    ledger = lg.run_search(x, pipe, maps, "fold", "label3", folder, "trees", parallelism=3)
    assert Counting.fits == 9 - 4 and ledger.count() == 9
    lg.run_search(x, pipe, maps, "fold", "label3", folder, "trees")
    assert Counting.fits == 5
    # another search in the folder, and changed parameters, are other fits
    assert lg.run_search(x, pipe, [{est.maxDepth: 3}], "fold", "label3", folder, "trees").count() == 3 and Counting.fits == 8

    table = {r["trial"]: r for r in lg.trial_table(ledger).collect()}
    for trial, pm in enumerate(maps):
        per = []
        for f in range(3):
            m = Pipeline(stages=[mo.BalancedWeights("label3"), est]).copy(pm).fit(x.where(F.col("fold") != f))
            pdf = m.transform(x.where(F.col("fold") == f)).select("label3", "prediction").toPandas()
            per.append(sk_scores(pdf.label3.to_numpy(), pdf.prediction.to_numpy()))
        for name, values in zip(("accuracy", "macro_f1", "weighted_f1"), np.array(per).T):
            assert table[trial][f"{name}_mean"] == pytest.approx(values.mean())
            assert table[trial][f"{name}_std"] == pytest.approx(values.std())
    best = [r for r in table.values() if r["is_best"]]
    assert len(best) == 1 and best[0]["weighted_f1_mean"] == max(r["weighted_f1_mean"] for r in table.values())


METRICS_SQL = """
WITH r AS (SELECT *, rank() OVER (PARTITION BY model, split, fold ORDER BY score)
             + (count(*) OVER (PARTITION BY model, split, fold, score) - 1) / 2.0 AS rk FROM p)
SELECT model, split, fold, count(*) AS n, avg((y = prediction)::INT) AS accuracy,
  coalesce(count_if(y = 1 AND prediction = 1) / nullif(count_if(prediction = 1), 0), 0) AS precision,
  coalesce(count_if(y = 1 AND prediction = 1) / nullif(count_if(y = 1), 0), 0) AS recall,
  (sum(rk) FILTER (WHERE y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0) / (count_if(y = 1) * count_if(y = 0)) AS roc_auc
FROM r GROUP BY ALL ORDER BY ALL"""


def test_stored_predictions_and_their_metrics(toy, tmp_path):
    """Every training row is predicted once out of fold and every test row once; the metrics equal SQL over the stored files."""
    models = {"lr": Pipeline(stages=[fe.ColumnTransformer(["a", "b"]), mo.make_estimator("lr", "label", maxIter=10)]),
              "rf": Pipeline(stages=[fe.ColumnTransformer(["a", "noise"]), mo.make_estimator("rf", "label", numTrees=5)]),
              "gnb": mo.GaussianNB(["a", "noise"])}
    folder = str(tmp_path / "pred")
    pred = lg.store_predictions(toy, models, "fold", F.col("held"), "label", ["id"], folder)
    rows = pred.toPandas()
    for _, mine in rows.groupby("model"):
        assert sorted(mine[mine.split == "cv"].id) == [i for i in range(500) if i % 5 != 4]
        assert sorted(mine[mine.split == "test"].id) == [i for i in range(500) if i % 5 == 4] and mine[mine.split == "test"].fold.isna().all()
        assert all(int(f) == i % 3 for i, f in zip(mine[mine.split == "cv"].id, mine[mine.split == "cv"].fold))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW p AS SELECT * FROM read_parquet('{folder}/*/*.parquet')")
    want = con.execute(METRICS_SQL).df()
    got = lg.metric_table(pred, ["model", "split", "fold"]).toPandas().sort_values(["model", "split", "fold"]).reset_index(drop=True)
    want = want.sort_values(["model", "split", "fold"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)

    report = {(r["model"], r["metric"]): r for r in lg.cv_report(pred).collect()}
    assert len(report) == 15
    for (model, metric), r in report.items():
        folds = want[(want.model == model) & (want.split == "cv")]
        if metric in folds:
            assert r["cv_mean"] == pytest.approx(folds[metric].mean()) and r["cv_std"] == pytest.approx(folds[metric].std(ddof=0))
            assert r["test"] == pytest.approx(want[(want.model == model) & (want.split == "test")][metric].iloc[0])
    mine = rows[(rows.model == "rf") & (rows.split == "cv")]
    assert report["rf", "accuracy"]["pooled"] == pytest.approx((mine.y == mine.prediction).mean())
    assert report["lr", "accuracy"]["too_good"] == (report["lr", "accuracy"]["test"] >= 0.99)
    # a second run reads what is there
    assert lg.store_predictions(toy, dict.fromkeys(models), "fold", F.col("held"), "label", ["id"], folder).count() == 1500


def test_boosted_classes(toy):
    """ML7: probabilities sum to 1, follow the margins, and weights reach every ensemble."""
    x = fe.assemble(toy, ["a", "b"])
    w = mo.BalancedWeights("label3").fit(x).transform(x)
    model = mo.BoostedOneVsRest("label3", weight="weight", maxIter=8, maxDepth=2).fit(w)
    pdf = model.transform(x).select("label3", "prediction", vector_to_array("probability").alias("p"), "margins").toPandas()
    p, m = np.array(pdf.p.tolist()), np.array(pdf.margins.tolist())
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == pdf.prediction).all()
    assert ((p[:, :1] > p[:, 1:2]) == (m[:, :1] > m[:, 1:2])).all()
    assert (pdf.label3 == pdf.prediction).mean() > 0.75
    plain = mo.BoostedOneVsRest("label3", maxIter=8, maxDepth=2).fit(x).transform(x).select(vector_to_array("probability")).collect()
    assert not np.allclose(np.array([r[0] for r in plain]), p)


def test_split_report_percentages(spark):
    df = spark.createDataFrame([("train", "x")] * 3 + [("train", "y")] + [("test", "x")] * 2, "split string, c string")
    got = {(r["split"], r["c"]): (r["n"], r["pct_of_split"], r["pct_of_class"], r["split_rows"]) for r in sp.split_report(df, "split", "c").collect()}
    assert got == {("train", "x"): (3, 75.0, 60.0, 4), ("train", "y"): (1, 25.0, 100.0, 4), ("test", "x"): (2, 100.0, 40.0, 2)}
