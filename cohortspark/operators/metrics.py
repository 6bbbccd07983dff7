"""Classification metrics (ME1-ME15).

Every count-based metric is derived from the confusion table — one grouped
count over (label, prediction), k*k rows — so scoring a billion predictions
is one partial aggregation. ROC-AUC uses MLlib's exact binary metrics
(``numBins=0``: distributed sort of distinct scores, tie-aware trapezoids =
the average-rank Mann-Whitney statistic, S26).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.ranking import running_total
from cohortspark.functions.presets import CV_AGREEMENT_STDS, OVERFIT_CUTS


# The status words of the over-fit report.
OVERFIT_WORDS = ("Good", "Moderate", "High")


def confusion(df: DataFrame, label: str, pred: str, classes: list | None = None) -> DataFrame:
    """ME1: (label, prediction, n) for every class pair, zero cells included. The classes are those of the
    data, as label or prediction (NULL too), and those named; so no row is left out. The counts (k*k at most)
    become one row, to which the empty grid of its classes is added: the table is read once."""
    counts = df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))
    kind = counts.schema["label"].dataType
    cell = F.struct(F.col("label"), F.col("prediction").cast(kind).alias("prediction"), F.col("n"))
    named = F.array(*[F.struct(F.lit(c).cast(kind).alias("c")) for c in classes or []]).cast(f"array<struct<c: {kind.simpleString()}>>")
    one = counts.agg(F.collect_list(cell).alias("cells"))
    seen = F.flatten(F.transform("cells", lambda x: F.array(F.struct(x["label"].alias("c")), F.struct(x["prediction"].alias("c")))))
    grid = F.flatten(F.transform("all", lambda a: F.transform("all", lambda b: F.struct(
        a["c"].alias("label"), b["c"].alias("prediction"), F.lit(0).cast("bigint").alias("n")))))
    every = one.withColumn("all", F.array_distinct(F.concat(seen, named)))
    return every.select(F.inline(F.concat("cells", grid))).groupBy("label", "prediction").agg(F.sum("n").alias("n"))


def _div(a: Column, b: Column) -> Column:
    """Zero when the denominator is zero (sklearn's zero_division=0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str, pred: str, positive=1) -> DataFrame:
    """ME2 + ME3: TP/TN/FP/FN, accuracy, precision, recall, F1, specificity, NPV."""
    y, p = F.col(label) == F.lit(positive), F.col(pred) == F.lit(positive)
    c = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"),
               F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    return c.select("tp", "tn", "fp", "fn",
                    _div(tp + tn, tp + tn + fp + fn).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), _div(2 * prec * rec, prec + rec).alias("f1"),
                    _div(tn, tn + fp).alias("specificity"), _div(tn, tn + fn).alias("npv"))


def class_report(conf: DataFrame) -> DataFrame:
    """ME4-ME6: per-class precision / recall / F1 / support plus 'macro avg'
    and 'weighted avg' rows, from a confusion table."""
    per = conf.groupBy("label").agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("label").eqNullSafe(F.col("prediction")), F.col("n")).otherwise(0)).alias("tp"))
    predicted = conf.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("pred_n"))
    m = per.join(predicted.withColumnRenamed("label", "__p"), F.col("label").eqNullSafe(F.col("__p")))
    m = m.select(F.col("label").cast("string").alias("class_name"), "support",
                 _div(F.col("tp"), F.col("pred_n")).alias("precision"),
                 _div(F.col("tp"), F.col("support")).alias("recall"))
    m = m.withColumn("f1", _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    macro = m.agg(F.lit("macro avg").alias("class_name"), F.sum("support").alias("support"),
                  F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    weighted = m.agg(F.lit("weighted avg").alias("class_name"), F.sum("support").alias("support"),
                     *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
                       for c in ("precision", "recall", "f1")])
    return m.unionByName(macro).unionByName(weighted)


def cohen_kappa(conf: DataFrame) -> DataFrame:
    """ME7: (po - pe) / (1 - pe) from a completed confusion table: on the
    diagonal cell of class c, row total x column total is that class's
    chance-agreement count."""
    r = F.sum("n").over(Window.partitionBy("label"))
    k = F.sum("n").over(Window.partitionBy("prediction"))
    diag = F.col("label").eqNullSafe(F.col("prediction"))
    m = conf.select("n", diag.alias("d"), r.alias("r"), k.alias("k"))
    s = m.agg(F.sum("n").alias("N"), F.sum(F.when(F.col("d"), F.col("n")).otherwise(0)).alias("agree"),
              F.sum(F.when(F.col("d"), F.col("r") * F.col("k")).otherwise(0)).alias("pe_num"))
    po = F.col("agree") / F.col("N")
    pe = F.col("pe_num") / (F.col("N") * F.col("N"))
    return s.select(po.alias("observed_agreement"), pe.alias("expected_agreement"),
                    F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(0.0)).alias("kappa"))


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> float:
    """ME8: exact ROC-AUC (ties count 1/2). ``+ 0.0`` folds -0.0 into 0.0 (S26)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    data = df.select((F.col(score).cast("double") + F.lit(0.0)).alias("__score"),
                     (F.col(label) == F.lit(positive)).cast("double").alias("__y"))
    ev = BinaryClassificationEvaluator(rawPredictionCol="__score", labelCol="__y",
                                       metricName="areaUnderROC", numBins=0)
    return float(ev.evaluate(data))


def grouped_auc(df: DataFrame, keys: list[str], positive: Column, score: Column, weight: Column | None = None) -> DataFrame:
    """Exact ROC-AUC (ties count 1/2) of every group in one pass: counts per (group, score), a running total
    of the negatives below (``running_total``: no group in one task), one sum. Returns keys, auc, n_pos."""
    w = weight if weight is not None else F.lit(1.0)
    y = positive.cast("double")
    c = df.select(*keys, (score.cast("double") + F.lit(0.0)).alias("__s"), (w * y).alias("__p"), (w * (1 - y)).alias("__q"))
    c = c.groupBy(*keys, "__s").agg(F.sum("__p").alias("__p"), F.sum("__q").alias("__q"))
    u = running_total(c, keys, [F.col("__s")], F.col("__q"), "__upto")
    return u.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("__p") * (F.col("__upto") - F.col("__q") / 2)), F.sum("__p") * F.sum("__q")).alias("auc"),
        F.sum("__p").alias("n_pos"))


def roc_auc_ovr(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """ME9: one-vs-rest AUC per class, plus macro and support-weighted means, all classes in one pass.
    ``scores`` maps class -> score column (probability or margin)."""
    entries = F.array(*[F.struct(F.lit(str(k)).alias("class_name"), (F.col(label) == F.lit(k)).alias("y"),
                                 F.col(s).cast("double").alias("s")) for k, s in scores.items()])
    per = grouped_auc(df.select(F.inline(entries)), ["class_name"], F.col("y"), F.col("s")).select(
        "class_name", "auc", F.col("n_pos").cast("bigint").alias("support"))
    total = F.sum("support").cast("bigint").alias("support")
    macro = per.agg(F.lit("macro avg").alias("class_name"), F.avg("auc").alias("auc"), total)
    weighted = per.agg(F.lit("weighted avg").alias("class_name"), (F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc"), total)
    return per.unionByName(macro).unionByName(weighted)


def fold_summary(per_fold: DataFrame, metrics: list[str]) -> DataFrame:
    """ME10: mean and population std of each metric across folds."""
    return per_fold.agg(*[e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])


def cv_vs_test(cv: DataFrame, test: DataFrame, metrics: list[str], width: float = CV_AGREEMENT_STDS) -> DataFrame:
    """ME11: per metric CV mean / std vs test value; 'Good' when within
    ``width`` std of the CV mean, else 'Check'."""
    cv_long = cv.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("cv_mean"),
                                                     F.col(f"{m}_std").alias("cv_std")) for m in metrics])).alias("s")).select("s.*")
    t_long = test.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("test"))
                                             for m in metrics])).alias("s")).select("s.*")
    j = cv_long.join(t_long, "metric")
    return j.withColumn("status", F.when(F.abs(F.col("test") - F.col("cv_mean")) <= width * F.col("cv_std"), "Good")
                        .otherwise("Check"))


def overfit_gap(train_acc: Column, test_acc: Column) -> Column:
    """ME12: gap class on train - test accuracy (< .05, < .10, else)."""
    lo, hi = OVERFIT_CUTS
    gap = train_acc - test_acc
    good, moderate, high = OVERFIT_WORDS
    return F.when(gap < lo, good).when(gap < hi, moderate).otherwise(high)


def per_fold_accuracy(pred: DataFrame, fold: str, label: str, prediction: str) -> DataFrame:
    """ME15 inputs: accuracy and size of every fold."""
    return pred.groupBy(fold).agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
                                  F.count(F.lit(1)).alias("n"))


def mean_vs_pooled(per_fold: DataFrame) -> DataFrame:
    """ME13 vs ME15: mean of fold accuracies vs accuracy of pooled predictions."""
    return per_fold.agg(F.avg("accuracy").alias("mean_fold_accuracy"),
                        (F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("pooled_accuracy"))
