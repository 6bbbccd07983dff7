"""MLlib classifiers and model reports (ML1-ML16, S10, S25).

Every model is an MLlib estimator (distributed training); feature vectors
come from ``VectorAssembler``; class weights are a ``weightCol`` (MLlib has no
``class_weight='balanced'``). Reports turn fitted parameters (coefficients,
importances, per-tree votes) into small DataFrames.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.profile import balanced_weights


def sklearn_c_to_reg(c: float, weight_sum: float) -> float:
    """S10: sklearn minimises 0.5|w|^2 + C * sum(loss); MLlib minimises
    mean(loss) + regParam * 0.5|w|^2, so regParam = 1 / (C * sum(w))."""
    return 1.0 / (c * weight_sum)


def make_estimator(kind: str, label: str = "label", features: str = "features", weight: str | None = None,
                   seed: int = 42, **params):
    """Build an MLlib classifier by name:
    lr, rf, gbt, gbt_ovr, dt, svc_ovr, nb, mlp."""
    from pyspark.ml import classification as C
    common = dict(labelCol=label, featuresCol=features)
    if kind == "lr":
        return C.LogisticRegression(**common, standardization=False, **({"weightCol": weight} if weight else {}),
                                    **params)
    if kind == "rf":
        return C.RandomForestClassifier(**common, seed=seed, **({"weightCol": weight} if weight else {}), **params)
    if kind == "gbt":
        return C.GBTClassifier(**common, seed=seed, **({"weightCol": weight} if weight else {}), **params)
    if kind == "dt":
        return C.DecisionTreeClassifier(**common, seed=seed, **({"weightCol": weight} if weight else {}), **params)
    if kind == "nb":
        return C.NaiveBayes(**common, modelType="gaussian", **({"weightCol": weight} if weight else {}), **params)
    if kind == "mlp":
        return C.MultilayerPerceptronClassifier(**common, seed=seed, **params)
    if kind == "gbt_ovr":
        return C.OneVsRest(classifier=C.GBTClassifier(seed=seed, **params), **common,
                           **({"weightCol": weight} if weight else {}))
    if kind == "svc_ovr":
        return C.OneVsRest(classifier=C.LinearSVC(**params), **common, **({"weightCol": weight} if weight else {}))
    raise ValueError(f"unknown model kind {kind}")


def with_balanced_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """S25 / AG22: n / (k * n_c) per row."""
    return balanced_weights(df, label, weight)


class _WeightParams(Params):
    scheme = Param(Params._dummy(), "scheme", "balanced: n / (k * n_c); positive: negatives per positive for label 1",
                   TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "name of the weight column", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="label", weightCol="weight", scheme="balanced")


class BalancedWeights(Estimator, _WeightParams, DefaultParamsReadable, DefaultParamsWritable):
    """S25 as a pipeline stage: the weight n / (k * n_c) of each class, or (scheme ``positive``) the number of
    negatives per positive for label 1, from the fitting rows only, so that a search refits it in every fold.
    Rows of other labels (and NULL) weigh 1."""

    def __init__(self, label: str = "label", weight: str = "weight", scheme: str = "balanced"):
        super().__init__()
        self._set(labelCol=label, weightCol=weight, scheme=scheme)

    def _fit(self, dataset: DataFrame) -> "BalancedWeightsModel":
        label = self.getOrDefault("labelCol")
        counts = dataset.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("double").alias("y")).count().collect()
        size = {float(r["y"]): r["count"] for r in counts}
        n, k = sum(size.values()), len(size)
        if self.getOrDefault("scheme") == "positive":
            weights = {1.0: (n - size[1.0]) / size[1.0]} if 1.0 in size else {}
        else:
            weights = {y: n / (k * c) for y, c in size.items()}
        return self._copyValues(BalancedWeightsModel()._set(classes=list(weights), weights=list(weights.values())))


class BalancedWeightsModel(Model, _WeightParams, DefaultParamsReadable, DefaultParamsWritable):
    classes = Param(Params._dummy(), "classes", "labels", TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "weight of each label", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(classes=[], weights=[])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w = F.lit(1.0)
        for c, v in zip(self.getOrDefault("classes"), self.getOrDefault("weights")):
            w = F.when(F.col(self.getOrDefault("labelCol")) == F.lit(c), F.lit(v)).otherwise(w)
        return dataset.withColumn(self.getOrDefault("weightCol"), w)


def coefficient_table(model, feats: list[str], classes: list | None = None) -> DataFrame:
    """ML14: signed / absolute coefficients per (class, feature) and the mean
    absolute coefficient over classes, ranked by it."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    lr = model.stages[-1] if hasattr(model, "stages") else model
    mat = lr.coefficientMatrix.toArray()
    classes = classes or list(range(mat.shape[0]))
    rows = [(str(classes[i]), f, float(mat[i, j])) for i in range(mat.shape[0]) for j, f in enumerate(feats)]
    t = spark.createDataFrame(rows, "class_name string, feature string, coef double")
    t = t.withColumn("abs_coef", F.abs("coef")).withColumn(
        "mean_abs_coef", F.avg("abs_coef").over(Window.partitionBy("feature")))
    return t.withColumn("rank", F.dense_rank().over(Window.orderBy(F.col("mean_abs_coef").desc(), F.col("feature"))))


def importance_table(model, feats: list[str]) -> DataFrame:
    """ML15: tree-ensemble feature importances, ranked."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    m = model.stages[-1] if hasattr(model, "stages") else model
    imp = m.featureImportances.toArray()
    t = spark.createDataFrame([(f, float(v)) for f, v in zip(feats, imp)], "feature string, importance double")
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), F.col("feature"))))


def tree_vote_agreement(model, data: DataFrame, features: str = "features") -> DataFrame:
    """ML16: every tree of a random forest predicts each row (one column per
    tree, no row explosion); the hard majority vote (ties to the lowest class)
    is compared with the forest's own (probability-averaging) prediction."""
    rf = model.stages[-1] if hasattr(model, "stages") else model
    x = data
    cols = []
    for i, tree in enumerate(rf.trees):
        tree = tree.copy()
        tree.setFeaturesCol(features).setPredictionCol(f"__t{i}").setRawPredictionCol(f"__r{i}").setProbabilityCol(f"__p{i}")
        x = tree.transform(x).drop(f"__r{i}", f"__p{i}")
        cols.append(f"__t{i}")
    n_cls = rf.numClasses
    def counter(k):
        return lambda acc, v: acc + (v == F.lit(float(k))).cast("int")
    votes = F.array(*[F.aggregate(F.array(*[F.col(c) for c in cols]), F.lit(0), counter(k))
                      for k in range(n_cls)])
    best = F.array_position(votes, F.array_max(votes)) - 1
    x = rf.transform(x).withColumn("vote", best.cast("double"))
    return x.agg(F.avg((F.col("vote") == F.col("prediction")).cast("double")).alias("agreement"),
                 F.count(F.lit(1)).alias("n"), F.lit(len(cols)).alias("n_trees"))


class MacroF1Evaluator(Evaluator):
    """ME6: macro-averaged F1 (plain mean of per-class F1) from one grouped
    count over (label, prediction). Usable inside ``CrossValidator``."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.labelCol, self.predictionCol = labelCol, predictionCol

    def _evaluate(self, dataset):
        c = dataset.groupBy(F.col(self.labelCol).alias("y"), F.col(self.predictionCol).alias("p")).count()
        tp = c.where(F.col("y") == F.col("p")).groupBy("y").agg(F.sum("count").alias("tp"))
        sup = c.groupBy("y").agg(F.sum("count").alias("support"))
        prd = c.groupBy(F.col("p").alias("y")).agg(F.sum("count").alias("pred"))
        j = sup.join(prd, "y", "full").join(tp, "y", "left").fillna(0)
        prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pred")), F.lit(0.0))
        rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
        return float(j.agg(F.avg(f1)).first()[0])

    def isLargerBetter(self):
        return True


def gaussian_nb_fit(train: DataFrame, feats: list[str], label: str, var_smoothing: float = 1e-9) -> DataFrame:
    """ML10 as a DataFrame program: per-class prior, mean and population
    variance (+ var_smoothing * largest feature variance, like sklearn).
    Returns the k-row parameter table."""
    long = train.select(F.col(label).alias("cls"), *[F.col(f).cast("double").alias(f) for f in feats])
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in feats:
        aggs += [F.avg(f).alias(f"m_{f}"), F.var_pop(f).alias(f"v_{f}")]
    per = long.groupBy("cls").agg(*aggs)
    eps = train.agg(F.greatest(*[F.var_pop(F.col(f).cast("double")) for f in feats]).alias("mx")) if len(feats) > 1 \
        else train.agg(F.var_pop(F.col(feats[0]).cast("double")).alias("mx"))
    eps_v = eps.first()["mx"] * var_smoothing
    w = Window.partitionBy()
    return per.select("cls", F.log(F.col("n") / F.sum("n").over(w)).alias("log_prior"),
                      *[F.col(f"m_{f}") for f in feats], *[(F.col(f"v_{f}") + F.lit(eps_v)).alias(f"v_{f}") for f in feats])


def gaussian_nb_predict(df: DataFrame, params: DataFrame, feats: list[str], key: list[str]) -> DataFrame:
    """Joint log-likelihood of every class as literal expressions (the
    parameter table has k rows and is read once); argmax with ties to the
    smallest class. No join: each row is scored in one projection."""
    import math
    prm = sorted(params.collect(), key=lambda r: r["cls"])
    jll = []
    for r in prm:
        e = F.lit(r["log_prior"])
        for f in feats:
            v, m = r[f"v_{f}"], r[f"m_{f}"]
            e = e - F.lit(0.5 * math.log(2 * math.pi * v)) - (F.col(f).cast("double") - F.lit(m)) ** 2 / F.lit(2 * v)
        jll.append(F.struct(e.alias("jll"), F.lit(-prm.index(r)).alias("neg_pos"), F.lit(r["cls"]).alias("cls")))
    best = F.greatest(*jll) if len(jll) > 1 else jll[0]
    return df.select(*key, best["cls"].alias("prediction"), best["jll"].alias("jll"))


class GaussianNB(Estimator):
    """ML10 as a pipeline stage over plain columns: the DataFrame program above for two classes (1 and any other).
    The model adds ``prediction`` (0 or 1, as double) and ``score``, the log odds of class 1, to nine digits."""

    def __init__(self, feats: list[str], label: str = "label"):
        super().__init__()
        self.feats, self.label = list(feats), label

    def _fit(self, dataset: DataFrame) -> "GaussianNBModel":
        params = gaussian_nb_fit(dataset, self.feats, self.label)
        return GaussianNBModel(self.feats, {float(r["cls"]): r.asDict() for r in params.collect()})


class GaussianNBModel(Model):
    def __init__(self, feats: list[str], params: dict[float, dict]):
        super().__init__()
        self.feats, self.fitted = feats, params

    def _log_likelihood(self, p: dict) -> Column:
        out = F.lit(p["log_prior"])
        for f in self.feats:
            x, m, v = F.col(f).cast("double"), p[f"m_{f}"], p[f"v_{f}"]
            out = out - F.lit(0.5 * math.log(2 * math.pi * v)) - (x - F.lit(m)) * (x - F.lit(m)) / F.lit(2 * v)
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        odds = F.round(self._log_likelihood(self.fitted[1.0]) - self._log_likelihood(self.fitted[0.0]), 9)
        return dataset.withColumns({"score": odds, "prediction": (odds > 0).cast("double")})


class BoostedOneVsRest(Estimator):
    """ML7: boosted trees for several classes (labels 0, 1, ...): one MLlib GBT per class against the rest, all with the
    rows' weights. The model gives ``margins``, ``probability`` (each tree ensemble's own probability, divided by
    their sum) and ``prediction`` (the largest; ties: the lowest class). The classes are fitted several at once."""

    def __init__(self, label: str = "label", features: str = "features", weight: str | None = None, seed: int = 42, parallelism: int = 3,
                 **params):
        super().__init__()
        self.label, self.features, self.weight, self.seed, self.parallelism, self.gbt = label, features, weight, seed, parallelism, params

    def _fit(self, dataset: DataFrame) -> "BoostedOneVsRestModel":
        from pyspark.ml.classification import GBTClassifier
        classes = sorted(r[0] for r in dataset.where(F.col(self.label).isNotNull()).select(F.col(self.label).cast("double")).distinct().collect())

        def one(c: float):
            gbt = GBTClassifier(labelCol="__is", featuresCol=self.features, seed=self.seed, **self.gbt,
                                **({"weightCol": self.weight} if self.weight else {}))
            return gbt.fit(dataset.withColumn("__is", (F.col(self.label) == F.lit(c)).cast("double")))

        with ThreadPoolExecutor(self.parallelism) as pool:
            return BoostedOneVsRestModel(classes, list(pool.map(one, classes)), self.features)


class BoostedOneVsRestModel(Model):
    def __init__(self, classes: list[float], models: list, features: str):
        super().__init__()
        self.classes, self.models, self.features = classes, models, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = dataset
        for i, m in enumerate(self.models):
            m = m.copy().setFeaturesCol(self.features).setPredictionCol(f"__o{i}").setRawPredictionCol(f"__r{i}").setProbabilityCol(f"__p{i}")
            x = m.transform(x)
        n = range(len(self.models))
        margins = F.array(*[vector_to_array(f"__r{i}")[1] for i in n])
        own = F.array(*[vector_to_array(f"__p{i}")[1] for i in n])
        x = x.withColumns({"margins": margins, "__own": own})
        total = F.aggregate("__own", F.lit(0.0), lambda a, v: a + v)
        share = F.transform("__own", lambda v: v / total)
        best = F.array_position("__own", F.array_max("__own")).cast("int") - 1
        classes = F.array(*[F.lit(c) for c in self.classes])
        x = x.withColumns({"probability": array_to_vector(share), "prediction": F.element_at(classes, best + 1)})
        return x.drop("__own", *[f"__{k}{i}" for k in "orp" for i in n])
