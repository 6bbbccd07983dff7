"""Model, tuning and model-report queries (ML*, TU*).

Fits are MLlib jobs over the whole lineitem table (train split); they are
rows-only in the SQL oracle check (a fitted model is not SQL), except the
Gaussian naive Bayes written as a DataFrame program, which DuckDB can mirror.
Search budgets are parameters; the registered queries use small budgets.
"""

from __future__ import annotations

import json

from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortspark.operators import metrics as me
from cohortspark.operators import models as mo
from cohortspark.operators import split as sp
from cohortspark.operators import tuning as tu
from cohortspark.operators import features as fe
from cohortspark.operators.features import ColumnTransformer, assemble
from cohortspark.plans.common import LI_KEY, LI_NUMERIC, LI_TARGET, r6, t
from cohortspark.plans.q_prep import C60, C70, C80, H_LI, _split_sql, cohort
from cohortspark.plans.registry import register
from cohortspark.session import stored_rows

FEATS = LI_NUMERIC
_CLASS_IDX = {"A": 0.0, "N": 1.0, "R": 2.0}


STRINGS = ["l_linestatus"]


def _frame(spark, d, three_way=False):
    li = t(spark, d, "lineitem").select(*LI_KEY, *[c for c in FEATS if c not in LI_KEY], *STRINGS, LI_TARGET, "l_shipdate")
    names, fr = (("train", "val", "test"), (0.6, 0.2, 0.2)) if three_way else (("train", "test"), (0.7, 0.3))
    li = sp.assign_split(li, LI_KEY, names, fr)
    idx = F.create_map(*[x for k, v in _CLASS_IDX.items() for x in (F.lit(k), F.lit(v))])
    li = li.withColumns({"label3": idx[F.col(LI_TARGET)], "label": (F.col(LI_TARGET) == "R").cast("double")})
    return assemble(sp.assign_folds(li, LI_KEY, k=3), FEATS)


def _weighted(train, label):
    return mo.with_balanced_weights(train, label, "weight")


def _scaled(train):
    """The FE16 transformer fitted on the training rows: scaled numbers and drop-first dummies."""
    return ColumnTransformer(FEATS, STRINGS, "scaled").fit(train)


@register("column_transform", "FE16 FE12 FE15", sql=f"""
WITH s AS (SELECT *, {_split_sql(H_LI, [C70], ['train', 'test'])} AS split FROM lineitem),
p AS (SELECT {', '.join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATS)}, min(l_linestatus) AS first_status FROM s WHERE split = 'train')
SELECT {', '.join(LI_KEY)}, {', '.join(f"round_even(({c} - m_{c}) / s_{c}, 6) AS x{i}" for i, c in enumerate(FEATS))},
       (l_linestatus <> first_status)::INTEGER::DOUBLE AS x{len(FEATS)} FROM s, p""")
def column_transform(spark, d):
    x = _frame(spark, d)
    m = _scaled(x.where(F.col("split") == "train"))
    v = m.transform(x).withColumn("v", vector_to_array("scaled"))
    return v.select(*LI_KEY, *[r6(F.col("v")[i]).alias(f"x{i}") for i in range(len(m.columns()))])


@register("lr_binary", "ML1 ML13 S10 S25 PR1 ML3 FE16")
def lr_binary(spark, d):
    x = _frame(spark, d)
    train = _weighted(x.where(F.col("split") == "train"), "label")
    scaler = _scaled(train)
    train = scaler.transform(train).select("scaled", "label", "weight").cache()   # several passes: keep the used columns
    est = mo.make_estimator("lr", "label", features="scaled", weight="weight", maxIter=50,
                            regParam=mo.sklearn_c_to_reg(0.1, train.count()), elasticNetParam=0.0)
    m = est.fit(train)
    train.unpersist()
    p = m.transform(scaler.transform(x.where(F.col("split") == "test")))
    return p.select(*LI_KEY, "label", "prediction", r6(vector_to_array("probability")[1]).alias("p1"))


@register("coef_rank", "ML14 ML2 WN7")
def coef_rank(spark, d):
    x = _frame(spark, d)
    train = _weighted(x.where(F.col("split") == "train"), "label3")
    scaler = _scaled(train)
    est = mo.make_estimator("lr", "label3", features="scaled", weight="weight", family="multinomial", maxIter=50,
                            regParam=0.01, elasticNetParam=0.5)
    m = est.fit(scaler.transform(train))
    return mo.coefficient_table(m, list(scaler.columns()), ["A", "N", "R"])


@register("rf_importance", "ML4 ML5 ML15")
def rf_importance(spark, d):
    x = _frame(spark, d)
    rows = stored_rows(x.where(F.col("split") == "train").select(*FEATS, "label3"), "forest-rows")
    train = _weighted(assemble(rows, FEATS), "label3")
    m = mo.make_estimator("rf", "label3", weight="weight", numTrees=20, maxDepth=5, minInstancesPerNode=10,
                          featureSubsetStrategy="sqrt").fit(train)
    return mo.importance_table(m, FEATS)


@register("tree_votes", "ML16")
def tree_votes(spark, d):
    x = _frame(spark, d)
    x = assemble(stored_rows(x.select(*FEATS, "label3", "split"), "forest-rows"), FEATS)
    m = mo.make_estimator("rf", "label3", numTrees=15, maxDepth=5).fit(x.where(F.col("split") == "train"))
    return mo.tree_vote_agreement(m, x.where(F.col("split") == "test"))


@register("gbt_binary", "ML6 ME2 ME8")
def gbt_binary(spark, d):
    x = _frame(spark, d, three_way=True)
    fit_rows = x.where(F.col("split") != "test").withColumn("is_val", F.col("split") == "val")
    m = mo.make_estimator("gbt", "label", maxIter=20, maxDepth=3, stepSize=0.1,
                          validationIndicatorCol="is_val").fit(fit_rows)
    p = m.transform(x.where(F.col("split") == "test"))
    b = me.binary_metrics(p, "label", "prediction", positive=1.0)
    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", numBins=0).evaluate(p)
    return b.select(*[r6(c).alias(c) for c in ["accuracy", "precision", "recall", "f1"]], r6(F.lit(auc)).alias("auc"))


def _multi_eval(p, name):
    conf = me.confusion(p.withColumn("y", F.col("label3").cast("int")).withColumn("yh", F.col("prediction").cast("int")),
                        "y", "yh", [0, 1, 2])
    rep = me.class_report(conf).where(F.col("class_name").isin("macro avg", "weighted avg"))
    return rep.select(F.lit(name).alias("model"), "class_name", *[r6(c).alias(c) for c in ["precision", "recall", "f1"]])


@register("model_zoo", "ML2 ML7 ML8 ML10 ML11 ML12 ME4 ME5 ME6 FE16")
def model_zoo(spark, d):
    """Rows-only: weighted / macro report of six 3-class MLlib models on the test split."""
    x = _frame(spark, d)
    scaler = _scaled(x.where(F.col("split") == "train"))
    x = stored_rows(x.select(*FEATS, *STRINGS, "split", "label3"), "zoo-rows")     # read by six fits
    x = scaler.transform(assemble(x, FEATS)).select("split", "label3", "features", "scaled")
    train = _weighted(x.where(F.col("split") == "train"), "label3")
    test = x.where(F.col("split") == "test")
    specs = {
        "lr_multinomial": mo.make_estimator("lr", "label3", features="scaled", weight="weight", family="multinomial",
                                            maxIter=30, regParam=0.01),
        "gbt_ovr": mo.make_estimator("gbt_ovr", "label3", maxIter=5, maxDepth=3),
        "decision_tree": mo.make_estimator("dt", "label3", weight="weight", maxDepth=5),
        "naive_bayes": mo.make_estimator("nb", "label3", weight="weight"),
        "linear_svc_ovr": mo.make_estimator("svc_ovr", "label3", features="scaled", maxIter=20, regParam=0.01),
        "mlp": mo.make_estimator("mlp", "label3", layers=[len(scaler.columns()), 8, 3], maxIter=30, features="scaled"),
    }
    out = None
    for name, est in specs.items():
        r = _multi_eval(est.fit(train).transform(test), name)
        out = r if out is None else out.unionByName(r)
    return out


@register("decision_tree_shape", "ML8")
def decision_tree_shape(spark, d):
    x = _frame(spark, d)
    m = mo.make_estimator("dt", "label3", maxDepth=6).fit(x.where(F.col("split") == "train"))
    imp = mo.importance_table(m, FEATS)
    return imp.withColumn("depth", F.lit(m.depth)).withColumn("num_nodes", F.lit(m.numNodes))


# ---------------------------------------------------------------- ML10 Gaussian NB as a DataFrame program
def _gnb_sql():
    split = _split_sql(H_LI, [C60, C80], ['train', 'val', 'test'])
    f = FEATS
    stats = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in f)
    mx = "greatest(" + ", ".join(f"var_pop({c})" for c in f) + ")"
    jll = " + ".join(f"(-0.5 * ln(2 * pi() * (v_{c} + eps)) - ({c} - m_{c}) * ({c} - m_{c}) / (2 * (v_{c} + eps)))" for c in f)
    return f"""
WITH s AS (SELECT *, {split} AS split FROM lineitem),
e AS (SELECT {mx} * 1e-9 AS eps FROM s WHERE split = 'train'),
p AS (SELECT l_returnflag AS cls, ln(count(*) / sum(count(*)) OVER ()) AS lp, {stats} FROM s WHERE split = 'train' GROUP BY 1),
j AS (SELECT {', '.join(LI_KEY)}, cls, lp + {jll} AS jll FROM s, p, e WHERE split = 'test')
SELECT {', '.join(LI_KEY)}, cls AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(LI_KEY)} ORDER BY jll DESC, cls) AS r FROM j) WHERE r = 1"""


@register("gnb_sql", "ML10", sql=_gnb_sql())
def gnb_sql(spark, d):
    li = sp.assign_split(t(spark, d, "lineitem"), LI_KEY, ("train", "val", "test"), (0.6, 0.2, 0.2))
    params = mo.gaussian_nb_fit(li.where(F.col("split") == "train"), FEATS, LI_TARGET)
    return mo.gaussian_nb_predict(li.where(F.col("split") == "test"), params, FEATS, LI_KEY).select(*LI_KEY, "prediction")


# ---------------------------------------------------------------- tuning
@register("random_search", "TU1 TU2 TU4 UD4")
def random_search(spark, d):
    x = stored_rows(_frame(spark, d).where(F.col("split") == "train").select(*FEATS, "label3", "fold"), "forest-rows")
    x = assemble(x, FEATS).select("features", "label3", "fold")
    est = mo.make_estimator("rf", "label3")
    space = {"numTrees": ("int", 5, 20), "maxDepth": [3, 4, 5, 6], "minInstancesPerNode": ("int", 1, 15),
             "featureSubsetStrategy": ["sqrt", "log2", "all"], "impurity": ["gini", "entropy"],
             "subsamplingRate": ("uniform", 0.5, 1.0)}
    maps = tu.sample_param_maps(est, space, n_iter=4, seed=42)
    _, trials = tu.cross_validate(x, est, maps, mo.MacroF1Evaluator("label3"), "fold", parallelism=4)
    return trials.select("trial", "params", r6("metric_mean").alias("metric_mean"), "rank", "is_best")


def _grouped(spark, d):
    """Training rows with leave-one-group-out folds: groups of ship years stand for survey cycles."""
    x = _frame(spark, d).withColumn("grp", F.year("l_shipdate") % 3)
    x, _ = sp.group_folds(x, "grp", out="year_fold")
    return stored_rows(x.where(F.col("split") == "train").select(*FEATS, *STRINGS, "label", "year_fold"), "grouped-rows")


@register("grid_logo", "TU3 TU5 TU9 SP5 ME15 ML3")
def grid_logo(spark, d):
    """Leave-one-group-out searches over C and l1_ratio with the scaler refitted in every fold: a grid and
    seeded draws (C log-uniform, l1_ratio uniform). The better search's own best model, refitted on all
    training rows with the exact parameters, gives the coefficients."""
    x = _grouped(spark, d)
    n = x.count()
    est = mo.make_estimator("lr", "label", maxIter=30)
    pipe = Pipeline(stages=[ColumnTransformer(FEATS, STRINGS), est])
    ev = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    c_to_reg = lambda c: mo.sklearn_c_to_reg(c, n)
    grid = tu.grid_param_maps(est, {"regParam": [c_to_reg(c) for c in (0.01, 1.0)], "elasticNetParam": [0.0, 0.5]})
    drawn = tu.sample_param_maps(est, {"regParam": ("loguniform", c_to_reg(10.0), c_to_reg(0.001)),
                                       "elasticNetParam": ("uniform", 0.0, 1.0)}, n_iter=3)
    found = {name: tu.cross_validate(x, pipe, maps, ev, "year_fold", parallelism=4)
             for name, maps in (("grid", grid), ("random", drawn))}
    picked = tu.better_search({name: trials for name, (_, trials) in found.items()})
    winner = picked.where("chosen").first()["search"]
    final = found[winner][0].bestModel
    names = list(final.stages[0].columns())
    coefs = {f: float(c) for f, c in zip(names, final.stages[-1].coefficientMatrix.toArray()[0])}
    return picked.select("search", "trial", "params", r6("metric_mean").alias("metric_mean"), "chosen",
                         F.lit(json.dumps(coefs, sort_keys=True)).alias("final_coefficients"))


@register("feature_set_sweep", "TU6 WN5 FE10 FE11 ME13")
def feature_set_sweep(spark, d):
    """Seven nested feature sets of the clinical-shaped table under group folds."""
    raw = cohort(spark, d).withColumns({"label": (F.col(LI_TARGET) == "R").cast("double"), "year_fold": F.col("l_linenumber") % 2})
    # stored by column: each fit reads the columns of its own set and multiplies its own products
    x = stored_rows(raw.repartition(*LI_KEY).transform(fe.engineer_features), "clinical")
    top = fe.top_correlated(x, fe.ENGINEERED, "label")
    terms = fe.interaction_terms(top, 3)
    sets = fe.nested_feature_sets(fe.BASE_SET, top)
    x = x.withColumns(terms).select(*dict.fromkeys(sets["7. Full + Polynomial"]), "label", "year_fold")
    s = tu.feature_set_sweep(x, sets, lambda: mo.make_estimator("lr", "label", maxIter=10, regParam=1e-4), "year_fold")
    return s.select("position", "feature_set", "n_features", *[r6(c).alias(c) for c in ("accuracy", "recall", "auc", "kappa", "gain_over_first")],
                    "is_best")


@register("rfe_ranking", "TU7")
def rfe_ranking(spark, d):
    x = _grouped(spark, d)
    r = tu.recursive_elimination(x, FEATS, lambda: mo.make_estimator("lr", "label", maxIter=20))
    return r.select("feature", "rfe_rank", r6("abs_coef_at_drop").alias("abs_coef_at_drop"))


@register("prefix_sweep", "TU8 TU6")
def prefix_sweep(spark, d):
    """The prefixes of the elimination ranking under the same group folds; the best is flagged."""
    x = _grouped(spark, d)
    make = lambda: mo.make_estimator("lr", "label", maxIter=20)
    ranking = [r["feature"] for r in tu.recursive_elimination(x, FEATS, make).orderBy("rfe_rank").collect()]
    s = tu.feature_set_sweep(x, tu.rank_prefixes(ranking), make, "year_fold")
    return s.select("position", "feature_set", "n_features", *[r6(c).alias(c) for c in ("accuracy", "recall", "auc", "kappa", "gain_over_first")],
                    "is_best")
