"""Scans (SC1-SC3, SC5-SC7): explicit-schema readers and schema reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Parquet table ``{base_dir}/{name}.parquet`` (column pruning and
    predicate pushdown happen at the scan)."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and an explicit schema (no inference pass over the data)."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Pick the reader by suffix: ``.csv`` needs a schema, anything else is parquet."""
    if path.endswith(".csv"):
        if schema is None:
            raise ValueError("CSV sources need an explicit schema")
        return read_csv(spark, path, schema)
    return spark.read.parquet(path)


def resolve_target(df: DataFrame, candidates: list[str]) -> str:
    """First candidate column present in ``df`` (SC5); raise if none."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of the target columns {candidates} present in {df.columns}")


def schema_frame(df: DataFrame) -> DataFrame:
    """The schema as a DataFrame (SC6): position, column, type, nullable."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, data_type string, nullable boolean")


def shape_frame(df: DataFrame) -> DataFrame:
    """Row and column count as one row (SC6), computed by one distributed count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint"))


def load_cohort(df: DataFrame, features: list[str], target: str, positive_value=None,
                label_col: str = "label") -> DataFrame:
    """Parameterised source (SC2 + PR1 + PR4): project the features and a 0/1 or
    passthrough label. ``positive_value`` turns a string target into 1/0
    (NULL counts as 0, like an equality test on missing)."""
    if positive_value is None:
        label = F.col(target)
    else:
        label = F.when(F.col(target) == F.lit(positive_value), 1).otherwise(0)
    return df.select(*[F.col(c) for c in features], label.alias(label_col))


def load_source(spark: SparkSession, source: str | DataFrame, features: list[str], target: str, positive_value=None,
                diagnostic: list[str] | None = None, exclude_diagnostic: bool = True, schema: T.StructType | str | None = None,
                label_col: str = "label") -> DataFrame:
    """SC2: the cohort of a path (format by suffix) or of a DataFrame. The ``diagnostic`` columns, which define the
    label, are left out unless ``exclude_diagnostic`` is off."""
    df = read_any(spark, source, schema) if isinstance(source, str) else source
    hidden = set(diagnostic or []) if exclude_diagnostic else set()
    return load_cohort(df, [c for c in features if c not in hidden], target, positive_value, label_col)
