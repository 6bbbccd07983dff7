import tempfile

from pyspark.sql import functions as F

from cohortspark.functions import columns as fx
from cohortspark.streaming import stream_transform
from conftest import SF_SMALL


def test_stream_stateless_projection(spark):
    src = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    out_dir = tempfile.mkdtemp(prefix="cohortspark-stream-")
    # the file source watches a folder: point it at a folder holding only lineitem
    in_dir = tempfile.mkdtemp(prefix="cohortspark-stream-in-")
    src.write.mode("overwrite").parquet(in_dir + "/data")

    def transform(df):
        return df.select("l_orderkey", fx.clip(F.col("l_quantity"), 2, 48).alias("q"),
                         fx.round_half_even(F.col("l_extendedprice") * 0.125, 2).alias("p"))

    q = stream_transform(spark, in_dir + "/data", src.schema, transform, out_dir + "/out", name="t_stream")
    q.awaitTermination(120)
    got = spark.read.parquet(out_dir + "/out")
    assert got.count() == src.count()
    assert got.agg(F.max("q")).first()[0] <= 48


def test_restart_resumes_without_repeats(spark, tmp_path):
    src = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    data, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for new, expect in ((True, 25), (True, 50), (False, 50)):
        if new:
            src.coalesce(1).write.mode("append").parquet(data)
        stream_transform(spark, data, src.schema, lambda df: df, sink).awaitTermination(120)
        assert spark.read.parquet(sink).count() == expect
        # a new session's checkpoint folder must not matter
        spark.sparkContext.setCheckpointDir(str(tmp_path / f"ckpt{expect}"))
