import os
import sys

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import split as sp
from conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))


def test_split_deterministic_disjoint_proportional(spark):
    df = spark.range(20000).withColumn("y", (F.col("id") % 3).cast("int"))
    a = sp.assign_split(df, ["id"], ("train", "val", "test"), (0.6, 0.2, 0.2))
    b = sp.assign_split(df.repartition(7), ["id"], ("train", "val", "test"), (0.6, 0.2, 0.2))
    ja = {r["id"]: r["split"] for r in a.collect()}
    jb = {r["id"]: r["split"] for r in b.collect()}
    assert ja == jb
    rep = {(r["split"], r["y"]): r["n"] for r in a.groupBy("split", "y").agg(F.count("*").alias("n")).collect()}
    for y in range(3):
        tot = sum(rep[(s, y)] for s in ("train", "val", "test"))
        assert abs(rep[("train", y)] / tot - 0.6) < 0.03


def test_folds_in_range(spark):
    df = sp.assign_folds(spark.range(5000), ["id"], k=5)
    counts = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}
    assert set(counts) == set(range(5)) and min(counts.values()) > 800


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "information_gain" in df.columns
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) >= 100


FAST_ORACLE = ["ig_ranking", "missing_report", "value_counts", "histogram_by_class", "crosstab_margins",
               "corr_matrix", "entropy_summary", "row_entropy", "rule_accuracy", "range_clip", "kfold",
               "engineered_features", "confusion_matrix", "class_report", "cohen_kappa", "auc_binary",
               "median_fill", "mode_fill", "silhouette_rows", "gnb_sql", "bootstrap_ci", "trait_labels",
               "stratified_split_exact", "kfold_exact", "knn_fill"]


@pytest.mark.parametrize("name", FAST_ORACLE)
def test_oracle_small(spark, name):
    import __spark_entry__ as E
    from check_oracle import compare, duck
    r = compare(spark, duck(SF_SMALL), name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert r["ok"], r
