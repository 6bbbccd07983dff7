"""Metric queries (ME1-ME15) on a deterministic rule prediction over lineitem.

3-class: label ``l_returnflag``, prediction from ``l_discount`` bands.
Binary: label ``l_returnflag = 'R'``, prediction ``l_quantity >= 25``,
score ``l_quantity`` (heavily tied, which exercises tie handling in AUC).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import metrics as me
from cohortspark.operators import split as sp
from cohortspark.plans.common import LI_KEY, LI_TARGET, r6, t
from cohortspark.plans.q_prep import C60, C70, C80, H_LI, _RULE_PRED, _rule_pred, _split_sql
from cohortspark.plans.registry import register

CLASSES = ["A", "N", "R"]
_PRED_SRC = (f"SELECT *, {_RULE_PRED} AS pred, (l_returnflag = 'R')::INTEGER AS y, "
             "(l_quantity >= 25)::INTEGER AS pred_bin FROM lineitem")


def _pred(spark, d):
    li = t(spark, d, "lineitem")
    return li.withColumns({"pred": _rule_pred(), "y": (F.col(LI_TARGET) == "R").cast("int"),
                           "pred_bin": (F.col("l_quantity") >= 25).cast("int")})


_CONF_SQL = f"""
SELECT g.label, g.prediction, coalesce(c.n, 0) AS n
FROM (SELECT a.v AS label, b.v AS prediction FROM (VALUES ('A'), ('N'), ('R')) a(v), (VALUES ('A'), ('N'), ('R')) b(v)) g
LEFT JOIN (SELECT l_returnflag AS label, pred AS prediction, count(*) AS n FROM ({_PRED_SRC}) GROUP BY ALL) c
USING (label, prediction)"""


@register("confusion_matrix", "ME1", sql=_CONF_SQL)
def confusion_matrix(spark, d):
    return me.confusion(_pred(spark, d), LI_TARGET, "pred", CLASSES)


def _bin_sql(where: str = "TRUE") -> str:
    return f"""
WITH c AS (SELECT count_if(y = 1 AND pred_bin = 1) AS tp, count_if(y = 0 AND pred_bin = 0) AS tn,
                  count_if(y = 0 AND pred_bin = 1) AS fp, count_if(y = 1 AND pred_bin = 0) AS fn FROM ({_PRED_SRC}) WHERE {where}),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS prec,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rec FROM c)
SELECT tp, tn, fp, fn, round_even((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round_even(prec, 6) AS precision,
       round_even(rec, 6) AS recall, round_even(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END, 6) AS f1,
       round_even(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS specificity,
       round_even(CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END, 6) AS npv FROM m"""


_BIN_COLS = ["accuracy", "precision", "recall", "f1", "specificity", "npv"]


@register("binary_metrics", "ME2 ME3", sql=_bin_sql())
def binary_metrics(spark, d):
    m = me.binary_metrics(_pred(spark, d), "y", "pred_bin")
    return m.select("tp", "tn", "fp", "fn", *[r6(c).alias(c) for c in _BIN_COLS])


_REPORT_SQL = f"""
WITH c AS ({_CONF_SQL}),
per AS (SELECT label AS class_name, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp FROM c GROUP BY 1),
pr AS (SELECT prediction AS class_name, sum(n) AS pred_n FROM c GROUP BY 1),
m AS (SELECT class_name, support, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM per JOIN pr USING (class_name)),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m),
allrows AS (SELECT class_name, support, precision, recall, f1 FROM f
  UNION ALL SELECT 'macro avg', sum(support), avg(precision), avg(recall), avg(f1) FROM f
  UNION ALL SELECT 'weighted avg', sum(support), sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support) FROM f)
SELECT class_name, CAST(support AS BIGINT) AS support, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall,
       round_even(f1, 6) AS f1 FROM allrows"""


@register("class_report", "ME4 ME5 ME6", sql=_REPORT_SQL)
def class_report(spark, d):
    r = me.class_report(me.confusion(_pred(spark, d), LI_TARGET, "pred", CLASSES))
    return r.select("class_name", F.col("support").cast("bigint").alias("support"),
                    *[r6(c).alias(c) for c in ["precision", "recall", "f1"]])


@register("cohen_kappa", "ME7", sql=f"""
WITH c AS ({_CONF_SQL}),
s AS (SELECT sum(n) AS nn, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS agree FROM c),
e AS (SELECT sum(r.t * k.t) AS pe_num FROM (SELECT label AS v, sum(n) AS t FROM c GROUP BY 1) r
      JOIN (SELECT prediction AS v, sum(n) AS t FROM c GROUP BY 1) k USING (v))
SELECT round_even(agree / nn, 6) AS observed_agreement, round_even(pe_num / (nn * nn), 6) AS expected_agreement,
       round_even((agree / nn - pe_num / (nn * nn)) / (1 - pe_num / (nn * nn)), 6) AS kappa FROM s, e""")
def cohen_kappa(spark, d):
    k = me.cohen_kappa(me.confusion(_pred(spark, d), LI_TARGET, "pred", CLASSES))
    return k.select(*[r6(c).alias(c) for c in ["observed_agreement", "expected_agreement", "kappa"]])


def _auc_sql(score: str, positive: str) -> str:
    return f"""
(WITH s AS (SELECT {score} + 0.0 AS score, (l_returnflag = '{positive}')::INTEGER AS y FROM lineitem),
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s),
n AS (SELECT count_if(y = 1) AS n1, count_if(y = 0) AS n0 FROM s)
SELECT (sum(rk) FILTER (WHERE y = 1) - any_value(n1) * (any_value(n1) + 1) / 2.0) / (any_value(n1) * any_value(n0)) FROM r, n)"""


@register("auc_binary", "ME8 S26", sql=f"SELECT round_even({_auc_sql('l_quantity', 'R')}, 6) AS auc, "
                                      "(SELECT count_if(l_returnflag = 'R') FROM lineitem) AS n_pos")
def auc_binary(spark, d):
    li = _pred(spark, d)
    auc = me.roc_auc(li, "y", "l_quantity")
    n_pos = li.agg(F.count_if(F.col("y") == 1).alias("n_pos"))
    return n_pos.select(r6(F.lit(auc)).alias("auc"), "n_pos")


_OVR = {"A": "l_discount", "N": "l_tax", "R": "l_quantity"}


@register("auc_ovr", "ME9", sql=f"""
WITH a AS ({' UNION ALL '.join(f"SELECT '{k}' AS class_name, {_auc_sql(s, k)} AS auc, (SELECT count_if(l_returnflag = '{k}') FROM lineitem) AS support" for k, s in _OVR.items())})
SELECT class_name, round_even(auc, 6) AS auc, support FROM a
UNION ALL SELECT 'macro avg', round_even(avg(auc), 6), sum(support)::BIGINT FROM a
UNION ALL SELECT 'weighted avg', round_even(sum(auc * support) / sum(support), 6), sum(support)::BIGINT FROM a""")
def auc_ovr(spark, d):
    r = me.roc_auc_ovr(t(spark, d, "lineitem"), LI_TARGET, _OVR)
    return r.select("class_name", r6("auc").alias("auc"), "support")


# ---------------------------------------------------------------- ME10 / ME11
_STEP5 = -(-sp.HASH_SPACE // 5)
_FOLD_SQL = f"CAST(least({sp.hash60_sql(LI_KEY, salt='fold')} // {_STEP5}, 4) AS INTEGER)"
_METRICS = ["accuracy", "precision", "recall", "f1", "auc"]
# rank-sum AUC of l_quantity per group: ranks inside the group, ties averaged
_AUC_BY = """SELECT {g}, (sum(rk) FILTER (WHERE y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0) / (count_if(y = 1) * count_if(y = 0)) AS auc
   FROM (SELECT {g}, y, rank() OVER (PARTITION BY {g} ORDER BY l_quantity) + (count(*) OVER (PARTITION BY {g}, l_quantity) - 1) / 2.0 AS rk
         FROM ({src})) GROUP BY {g}"""


def _cv_sql():
    split = _split_sql(H_LI, [C70], ['train', 'test'])
    src = f"SELECT *, {split} AS split, {_FOLD_SQL} AS fold FROM ({_PRED_SRC})"
    per_fold = f"""SELECT fold, avg((y = pred_bin)::INTEGER) AS accuracy,
        coalesce(count_if(y = 1 AND pred_bin = 1) / nullif(count_if(pred_bin = 1), 0), 0) AS precision,
        coalesce(count_if(y = 1 AND pred_bin = 1) / nullif(count_if(y = 1), 0), 0) AS recall FROM ({src}) WHERE split = 'train' GROUP BY fold"""
    test = f"""SELECT avg((y = pred_bin)::INTEGER) AS accuracy,
        coalesce(count_if(y = 1 AND pred_bin = 1) / nullif(count_if(pred_bin = 1), 0), 0) AS precision,
        coalesce(count_if(y = 1 AND pred_bin = 1) / nullif(count_if(y = 1), 0), 0) AS recall FROM ({src}) WHERE split = 'test'"""
    f1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END"
    auc_fold = _AUC_BY.format(g="fold", src=f"SELECT * FROM ({src}) WHERE split = 'train'")
    auc_test = _AUC_BY.format(g="split", src=f"SELECT * FROM ({src}) WHERE split = 'test'")
    pf = f"SELECT m.*, {f1} AS f1, auc FROM ({per_fold}) m JOIN ({auc_fold}) USING (fold)"
    tt = f"SELECT m.*, {f1} AS f1, auc FROM ({test}) m, ({auc_test})"
    parts = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, (SELECT avg({m}) FROM pf) AS cv_mean, (SELECT stddev_pop({m}) FROM pf) AS cv_std, "
        f"(SELECT {m} FROM tt) AS test" for m in _METRICS)
    return f"""WITH pf AS ({pf}), tt AS ({tt}), x AS ({parts})
SELECT metric, round_even(cv_mean, 6) AS cv_mean, round_even(cv_std, 6) AS cv_std, round_even(test, 6) AS test,
       CASE WHEN abs(test - cv_mean) <= 2 * cv_std THEN 'Good' ELSE 'Check' END AS status FROM x"""


def _fold_metrics(df, group):
    yp = (F.col("y") == 1) & (F.col("pred_bin") == 1)
    prec = F.coalesce(F.try_divide(F.count_if(yp), F.count_if(F.col("pred_bin") == 1)), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.count_if(yp), F.count_if(F.col("y") == 1)), F.lit(0.0))
    g = df.groupBy(*group) if group else df
    m = g.agg(F.avg((F.col("y") == F.col("pred_bin")).cast("double")).alias("accuracy"),
              prec.cast("double").alias("precision"), rec.cast("double").alias("recall"))
    m = m.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                  2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                     .otherwise(0.0))
    by = group or ["__all"]
    auc = me.grouped_auc(df.withColumn("__all", F.lit(0)), by, F.col("y") == 1, F.col("l_quantity")).select(*by, "auc")
    return m.join(auc, group) if group else m.withColumn("__all", F.lit(0)).join(auc, "__all").drop("__all")


def _kappa_by(df, group):
    """Cohen's kappa of the binary prediction per group, from one count table."""
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("a"), F.sum("pred_bin").alias("b"),
                               F.sum((F.col("y") == F.col("pred_bin")).cast("long")).alias("ok"))
    pe = (F.col("a") * F.col("b") + (F.col("n") - F.col("a")) * (F.col("n") - F.col("b"))) / (F.col("n") * F.col("n"))
    return n.select(*group, ((F.col("ok") / F.col("n") - pe) / (1 - pe)).alias("kappa"))


def _cv_frame(spark, d):
    li = sp.assign_split(_pred(spark, d), LI_KEY)
    return sp.assign_folds(li, LI_KEY, k=5)


@register("cv_vs_test", "ME10 ME11 SP4", sql=_cv_sql())
def cv_vs_test(spark, d):
    li = _cv_frame(spark, d)
    per_fold = _fold_metrics(li.where(F.col("split") == "train"), ["fold"])
    test = _fold_metrics(li.where(F.col("split") == "test"), [])
    r = me.cv_vs_test(me.fold_summary(per_fold, _METRICS), test, _METRICS)
    return r.select("metric", *[r6(c).alias(c) for c in ["cv_mean", "cv_std", "test"]], "status")


@register("overfit_gap", "ME12", sql=f"""
WITH s AS (SELECT {_split_sql(H_LI, [C70], ['train', 'test'])} AS split, l_returnflag = pred AS ok FROM ({_PRED_SRC})),
a AS (SELECT avg(ok::INTEGER) FILTER (WHERE split = 'train') AS tr, avg(ok::INTEGER) FILTER (WHERE split = 'test') AS te FROM s)
SELECT round_even(tr, 6) AS train_accuracy, round_even(te, 6) AS test_accuracy, round_even(tr - te, 6) AS gap,
       CASE WHEN tr - te < 0.05 THEN 'Good' WHEN tr - te < 0.1 THEN 'Moderate' ELSE 'High' END AS gap_class FROM a""")
def overfit_gap(spark, d):
    li = sp.assign_split(_pred(spark, d), LI_KEY)
    ok = (F.col(LI_TARGET) == F.col("pred")).cast("double")
    a = li.agg(F.avg(F.when(F.col("split") == "train", ok)).alias("tr"), F.avg(F.when(F.col("split") == "test", ok)).alias("te"))
    return a.select(r6("tr").alias("train_accuracy"), r6("te").alias("test_accuracy"),
                    r6(F.col("tr") - F.col("te")).alias("gap"), me.overfit_gap(F.col("tr"), F.col("te")).alias("gap_class"))


@register("fold_mean_vs_pooled", "ME13 ME15", sql=f"""
WITH s AS (SELECT {_FOLD_SQL} AS fold, l_returnflag = pred AS ok FROM ({_PRED_SRC})),
f AS (SELECT fold, avg(ok::INTEGER) AS acc, count(*) AS n FROM s GROUP BY fold)
SELECT round_even(avg(acc), 6) AS mean_fold_accuracy, round_even(sum(acc * n) / sum(n), 6) AS pooled_accuracy FROM f""")
def fold_mean_vs_pooled(spark, d):
    li = sp.assign_folds(_pred(spark, d), LI_KEY, k=5)
    r = me.mean_vs_pooled(me.per_fold_accuracy(li, "fold", LI_TARGET, "pred"))
    return r.select(r6("mean_fold_accuracy").alias("mean_fold_accuracy"), r6("pooled_accuracy").alias("pooled_accuracy"))


@register("eval_summary", "ME14 SP2", sql=f"""
WITH s AS (SELECT {_split_sql(H_LI, [C60, C80], ['train', 'val', 'test'])} AS split, * FROM ({_PRED_SRC})),
m AS (SELECT split, avg((y = pred_bin)::INTEGER) AS accuracy,
             coalesce(count_if(y = 1 AND pred_bin = 1) / nullif(count_if(pred_bin = 1), 0), 0) AS precision,
             coalesce(count_if(y = 1 AND pred_bin = 1) / nullif(count_if(y = 1), 0), 0) AS recall FROM s GROUP BY split),
au AS ({_AUC_BY.format(g="split", src="SELECT * FROM s")}),
ka AS (SELECT split, (po - pe) / (1 - pe) AS kappa FROM (SELECT split, avg((y = pred_bin)::INTEGER) AS po,
       avg(y) * avg(pred_bin) + (1 - avg(y)) * (1 - avg(pred_bin)) AS pe FROM s GROUP BY split)),
l AS (SELECT split, 'accuracy' AS metric, accuracy AS v FROM m UNION ALL SELECT split, 'precision', precision FROM m
      UNION ALL SELECT split, 'recall', recall FROM m UNION ALL SELECT split, 'f1', 2 * precision * recall / (precision + recall) FROM m
      UNION ALL SELECT split, 'auc', auc FROM au UNION ALL SELECT split, 'kappa', kappa FROM ka)
SELECT metric, round_even(max(v) FILTER (WHERE split = 'train'), 6) AS train, round_even(max(v) FILTER (WHERE split = 'val'), 6) AS val,
       round_even(max(v) FILTER (WHERE split = 'test'), 6) AS test FROM l GROUP BY metric""")
def eval_summary(spark, d):
    li = sp.assign_split(_pred(spark, d), LI_KEY, ("train", "val", "test"), (0.6, 0.2, 0.2))
    m = _fold_metrics(li, ["split"]).join(_kappa_by(li, ["split"]), "split")
    long = m.unpivot(["split"], ["accuracy", "precision", "recall", "f1", "auc", "kappa"], "metric", "v")
    p = long.groupBy("metric").pivot("split", ["train", "val", "test"]).agg(F.max("v"))
    return p.select("metric", *[r6(c).alias(c) for c in ["train", "val", "test"]])
