"""Imputation (IM1-IM5, S16, S27).

Fill values are a few numbers per column (exact medians, modes) applied with
``coalesce`` in one projection; the KNN fill runs the exact grid k-NN join per
target column and writes back through a key join; the model fill trains an
MLlib random forest on the donor table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.knn import knn_join
from cohortspark.operators.quantiles import exact_quantiles
from cohortspark.session import cut_lineage, stored


def median_fill(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict]:
    """IM1: replace NULLs with the exact median of each column."""
    med = {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(med[c]).cast(df.schema[c].dataType))
                           for c in cols if med[c] is not None}), med


def modes(df: DataFrame, cols: list[str]) -> dict:
    """AG18 / S27: most frequent value per column, ties to the lowest value. All columns are counted in
    one job (one grouping set per column); a single row reaches the driver."""
    names = {c: f"__m{i}" for i, c in enumerate(cols)}
    counts = (df.select(*[F.col(c).alias(n) for c, n in names.items()])
              .groupingSets([[F.col(n)] for n in names.values()], *[F.col(n) for n in names.values()])
              .agg(F.count(F.lit(1)).alias("__n")))
    row = counts.agg(*[F.min_by(F.col(n), F.when(F.col(n).isNotNull(), F.struct(-F.col("__n"), F.col(n)))).alias(n)
                       for n in names.values()]).first()
    return {c: row[n] for c, n in names.items()}


def mode_fill(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict]:
    """IM2: replace NULLs with each column's mode."""
    m = modes(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m[c]).cast(df.schema[c].dataType))
                           for c in cols if m[c] is not None}), m


def knn_fill(df: DataFrame, key: list[str], feats: list[str], grid: list[str] | None = None, k: int = 5,
             targets: list[str] | None = None, occupancy: int = 64, visited: dict | None = None) -> DataFrame:
    """IM4 / S16: KNN imputation, k neighbours, 1/d weights, nan-Euclidean
    distance over ``feats``. A row that misses targets is one query per missing target, and its donors are
    the rows having that target; all targets are searched in one join. Zero-distance donors take all the
    weight; a row with no usable donor gets the column mean. Any column may have gaps and be filled."""
    targets = targets or feats
    means = df.agg(*[F.avg(F.col(c)).alias(c) for c in targets]).first()
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in targets]), lambda x: x.isNotNull())
    q = df.withColumn("__need", F.explode(missing)).select(*key, *feats, "__need")
    d = df.where(F.coalesce(*[F.col(c).cast("double") for c in targets]).isNotNull()).select(*dict.fromkeys([*key, *feats, *targets]))
    nn = knn_join(q, d, [*key, "__need"], key, feats, k, metric="nan_euclidean", occupancy=occupancy, donor_cols=targets,
                  need="__need", needs=targets, visited=visited)
    has_zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy(*key, "__need"))
    w = F.when(has_zero == 1, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    own = {c: F.when(F.col("__need") == c, F.col("__w")) for c in targets}
    filled = nn.withColumn("__w", w).groupBy(*key).agg(
        *[F.try_divide(F.sum(own[c] * F.col(f"d_{c}")), F.sum(own[c])).alias(f"__fill_{c}") for c in targets])
    out = df.join(filled, key, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"__fill_{c}"), F.lit(means[c])) for c in targets})
    return stored(out.select(*df.columns), "knn-filled")


def model_fill(df: DataFrame, donors: DataFrame, target: str, feats: list[str], num_trees: int = 200,
               max_depth: int = 10, min_split: int = 5, seed: int = 42, balanced: bool = True):
    """IM3: train a random forest on the donors that have the target and every feature (balanced class weights,
    S25), predict ``target`` for rows missing it that have every feature, and
    fill the rest with the mode. Returns (filled frame, fitted model).
    ``min_split`` maps to minInstancesPerNode = ceil(min_split / 2)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler, IndexToString
    from cohortspark.operators.profile import balanced_weights
    train = donors.where(F.col(target).isNotNull()).na.drop(subset=feats)      # neither NULL nor NaN
    if balanced:
        train = balanced_weights(train, target, "__w")
    idx = StringIndexer(inputCol=target, outputCol="__y", stringOrderType="alphabetAsc").fit(train)
    rf = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=num_trees, maxDepth=max_depth,
                                minInstancesPerNode=max(1, (min_split + 1) // 2), seed=seed,
                                weightCol="__w" if balanced else None)
    pipe = Pipeline(stages=[idx, VectorAssembler(inputCols=feats, outputCol="__x"), rf]).fit(train)
    ok = F.col(target).isNull()
    for f in feats:
        ok = ok & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    to_predict = df.where(ok)
    pred = pipe.transform(to_predict)
    labels = IndexToString(inputCol="prediction", outputCol="__pred", labels=idx.labels).transform(pred)
    pred_cols = [c for c in df.columns if c != target]
    predicted = labels.select(*pred_cols, F.col("__pred").cast(df.schema[target].dataType).alias(target))
    rest = df.where(~ok)
    filled = cut_lineage(rest.unionByName(predicted.select(*df.columns)))   # the forest scores once
    filled, _ = mode_fill(filled, [target])
    return filled, pipe


def fill_report(donors: DataFrame, filled: DataFrame, was_missing, target: str, feats: list[str], key: list[str], k: int = 5,
                num_trees: int = 200, max_depth: int = 10, seed: int = 42) -> DataFrame:
    """IM3 / IM5: what backs a model fill, as long rows (part, name, value): accuracy of k-fold forests on the
    donor table, importances of the forest on all donors, and the share of each value among filled rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from cohortspark.operators.split import assign_folds
    complete = donors.where(F.col(target).isNotNull())
    for f in feats:
        complete = complete.where(F.col(f).isNotNull())
    complete = complete.na.drop(subset=feats)       # nor NaN
    idx = StringIndexer(inputCol=target, outputCol="__y", stringOrderType="alphabetAsc").fit(complete)
    rows = cut_lineage(VectorAssembler(inputCols=feats, outputCol="__x").transform(idx.transform(assign_folds(complete, key, k, out="__fold")))
                       .select("__x", "__y", "__fold"))
    forest = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=num_trees, maxDepth=max_depth, seed=seed)
    right = None
    for i in range(k):
        m = Pipeline(stages=[forest]).fit(rows.where(F.col("__fold") != i))
        p = m.transform(rows.where(F.col("__fold") == i)).select((F.col("prediction") == F.col("__y")).cast("double").alias("ok"))
        right = p if right is None else right.unionByName(p)
    accuracy = right.agg(F.lit("accuracy").alias("part"), F.lit(f"{k}-fold").alias("name"), F.avg("ok").alias("value"))
    imp = forest.fit(rows).featureImportances.toArray()
    importance = donors.sparkSession.createDataFrame([("importance", f, float(v)) for f, v in zip(feats, imp)], accuracy.schema)
    counts = cut_lineage(filled.where(was_missing).groupBy(F.col(target).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    share = counts.select(F.lit("share").alias("part"), "name", (F.col("n") / F.lit(total)).alias("value"))
    return accuracy.unionByName(importance).unionByName(share)
