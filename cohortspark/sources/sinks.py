"""Sinks (SC4): overwrite-mode writers; parquet by default, CSV with header on request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = "__flags"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> str:
    """Write ``df`` to ``path``. Parent folders are created by the writer; the
    write is task-atomic through the output committer, so a lost executor only
    re-runs its tasks."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_flagged(df: DataFrame, flags: dict[str, Column], path: str) -> tuple[DataFrame, DataFrame]:
    """PR11 / OU2 / PR16: write ``df`` once, each row with a bit mask of the named conditions that hold for it (NULL
    counts as false). Returns the written rows with their mask (column ``__flags``) and the counts (flag, n, n_rows), which
    read the mask column of the written files only: the source is scanned once, by the write."""
    if len(flags) > 62:
        raise ValueError("more than 62 flags")
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(flags.values())]
    mask = bits[0] if len(bits) == 1 else sum(bits[1:], bits[0])
    df.withColumn(FLAGS, mask).write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.parquet(path)
    one = rows.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(has_flag(flags, name)).alias(f"f{i}") for i, name in enumerate(flags)])
    counts = one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("flag"), F.col(f"f{i}").alias("n"), F.col("n_rows"))
                                           for i, name in enumerate(flags)])))
    return rows, counts


def has_flag(flags: dict[str, Column], *names: str) -> Column:
    """Whether a written row has any of the named flags."""
    order = list(flags)
    return F.col(FLAGS).bitwiseAND(F.lit(sum(1 << order.index(n) for n in names)).cast("bigint")) != 0
