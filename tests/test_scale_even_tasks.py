"""Scans of stored rows are even, group folds shuffle no rows, the vector search sends a query once to a shelf, batches are small."""

import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cohortspark.llm import dart_minhash
from cohortspark.operators import profile as pf
from cohortspark.operators import split as sp
from cohortspark.operators import tuning as tu
from cohortspark.operators import vector_index as vi
from cohortspark.session import checkpoint_dir, stored_rows


def test_group_folds_leave_the_rows_where_they_are(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 7 != 0, F.col("id") % 3)).repartition(8)
    out, table = sp.group_folds(df, "g")
    assert {(r["g"], r["fold"]) for r in table.collect()} == {(0, 0), (1, 1), (2, 2)}
    # three groups: a join by shuffle would leave rows in at most four of the partitions
    used = out.withColumn("p", F.spark_partition_id()).select("p").distinct().count()
    assert used == 8
    assert out.where("NOT fold <=> g").count() == 0 and out.count() == 3000


def test_stored_rows_are_written_in_small_row_groups(spark):
    df = spark.range(0, 400_000, 1, 1).select(F.rand(1).alias("a"), F.rand(2).alias("b"))
    got = stored_rows(df, "even-rows")
    files = glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/even-rows-*/*.parquet")
    assert min(pq.ParquetFile(f).num_row_groups for f in files) >= 4
    assert got.count() == 400_000


def test_out_of_fold_fits_several_folds_at_once(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(a + e > 0), i % 3) for i, (a, e) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "a double, label double, fold int").repartition(4)
    from pyspark.ml import Pipeline

    from cohortspark.operators import models as mo
    from cohortspark.operators.features import ColumnTransformer
    pipe = Pipeline(stages=[ColumnTransformer(["a"]), mo.make_estimator("lr", "label", maxIter=10)])
    one, three = ([r for r in next(tu._out_of_fold(df, [pipe], "fold", ["a", "label"], parallelism=n)).orderBy("a").collect()] for n in (1, 3))
    assert len(one) == 600 and [(r["a"], r["fold"], r["prediction"], round(r["score"], 9)) for r in one] == [
        (r["a"], r["fold"], r["prediction"], round(r["score"], 9)) for r in three]


def test_distinct_counts_copy_no_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, "x", nan), (2, None, nan), (3, "x", 0.0), (4, "", -0.0), (5, "y", None)], "a int, b string, c double")
    got = pf.distinct_counts(df, ["a", "b", "c"])
    assert [tuple(r) for r in got.orderBy("column_name").collect()] == [("a", 5, True), ("b", 3, False), ("c", 2, False)]
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    empty = pf.distinct_counts(df.limit(0), ["a", "b"])
    assert sorted(tuple(r) for r in empty.collect()) == [("a", 0, True), ("b", 0, True)]


def test_a_query_goes_once_to_a_shelf(spark, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK", 16)
    monkeypatch.setattr(vi, "SHELVES", 4)
    sent = {}
    real = vi._meet

    def counted(packs, shelves, *args):
        sent["rows"], sent["shelves"] = packs.selectExpr("sum(size(queries))").first()[0], shelves.count()
        return real(packs, shelves, *args)

    monkeypatch.setattr(vi, "_meet", counted)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 32))
    x[:300] = x[0]                                              # a large cell, on shelves of its own
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = vi.vector_knn(df.where("id % 20 = 0"), df, ["id"], ["id"], "v", 3).collect()
    d = np.sqrt(((x[::20, None] - x[None]) ** 2).sum(axis=2))
    want = {(20 * i, n, j) for i, row in enumerate(d) for n, j in enumerate(np.lexsort((np.arange(800), row.round(9)))[:3], 1)}
    assert {(r["id"], r["nn_rank"], r["d_id"]) for r in got} == want
    assert sent["shelves"] <= 10 and sent["rows"] <= 40 * sent["shelves"]


def test_signatures_and_units_are_made_in_small_batches(spark, monkeypatch):
    seen = []
    real = dart_minhash.stored
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(dart_minhash, "stored", lambda df, n: (seen.append((n, int(spark.conf.get(name)))), real(df, n))[1])
    before = spark.conf.get(name)
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 4, 30))) for i in range(40)], "doc_id long, text string")
    assert dart_minhash.near_duplicates(df).count() == 40
    used = dict(seen)
    assert used["dart-signatures"] <= dart_minhash.BATCH_ROWS and used["dart-units"] <= dart_minhash.BATCH_ROWS
    assert spark.conf.get(name) == before
