"""Stand-in roles on the test tables and output helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.sources import read_table

LI_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_CATEGORICAL = ["l_linestatus"]
LI_TARGET = "l_returnflag"
# unique row key of lineitem at sf0.01 / sf0.1 (plus value tie-breaks)
LI_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def r6(c: Column | str, digits: int = 6) -> Column:
    """numpy-style half-even rounding (S5); equals DuckDB ``round_even``."""
    from cohortspark.functions.columns import round_half_even
    col = F.col(c) if isinstance(c, str) else c
    return round_half_even(col, digits)


def lineitem_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem with value-driven missing entries for imputation / NULL-policy
    queries: quantity is missing on zero-tax rows, extended price on rows
    with the top discount. Every row is kept."""
    li = t(spark, sf_dir, "lineitem")
    return li.withColumns({
        "l_quantity": F.when(F.col("l_tax") != 0.0, F.col("l_quantity")),
        "l_extendedprice": F.when(F.col("l_discount") != 0.1, F.col("l_extendedprice")),
    })
