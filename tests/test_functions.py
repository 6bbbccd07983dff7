import math

from pyspark.sql import functions as F

from cohortspark.functions import columns as fx
from cohortspark.functions.stats import t_two_sided_p


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(2.125,), (2.135,), (-0.5,)], "x double")
    got = [r[0] for r in df.select(fx.round_half_even("x", 2)).collect()]
    assert got[0] == 2.12  # numpy: 2.12


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-1.0,)], "x double")
    got = [r[0] for r in df.select(fx.clip(F.col("x"), 0.0, 3.0)).collect()]
    assert got == [None, 3.0, 0.0]


def test_safe_ratio_and_logs(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0)], "a double, b double")
    r = df.select(fx.bare_ratio("a", "b").alias("r"), fx.safe_log10(F.col("b")).alias("l")).collect()
    assert r[0]["r"] is None and r[0]["l"] is None and r[1]["r"] == 2.0


def test_ordinal_unmapped_is_null(spark):
    df = spark.createDataFrame([("Light",), ("Unknown",), (None,)], "a string")
    got = [r[0] for r in df.select(fx.ordinal_encode("a", {"Light": 0, "Moderate": 1, "Heavy": 2})).collect()]
    assert got == [0, None, None]


def test_period_split(spark):
    df = spark.createDataFrame([("2021-2023",), ("bad",)], "p string")
    got = df.select(fx.period_start("p"), fx.period_end("p")).collect()
    assert tuple(got[0]) == (2021, 2023) and got[1][0] is None


def test_t_pvalue_against_integration():
    import numpy as np
    for t, dof in [(2.0, 10), (0.5, 30), (3.5, 5)]:
        x = np.linspace(abs(t), 200, 2_000_001)
        c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
        pdf = c * (1 + x * x / dof) ** (-(dof + 1) / 2)
        p_num = 2 * np.trapezoid(pdf, x)
        assert abs(t_two_sided_p(t, dof) - p_num) < 1e-6


def test_csv_scan_and_sink_roundtrip(spark):
    import tempfile
    from cohortspark.sources import read_any, write_table
    d = tempfile.mkdtemp(prefix="cohortspark-csv-")
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b")], "SEQN bigint, bmi double, s string")
    write_table(df.coalesce(1), d + "/out.csv", fmt="csv")
    back = read_any(spark, d + "/out.csv", schema="SEQN bigint, bmi double, s string")
    assert sorted(back.collect()) == sorted(df.collect())
