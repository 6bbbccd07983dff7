"""Pearson correlation reports (AG31-AG34).

All pairwise coefficients come from one pass, pairwise-complete (rows where either side is NULL are left
out). Up to ``FEW_COLUMNS`` columns that is one aggregation with a ``corr`` per pair. For more columns the
number of expressions would grow with their square, so every task sums packed Gram matrices of its Arrow
batches instead (counts, sums, squares and products of each pair, as matrix products), and the sums
of the tasks are added up by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the "highly correlated" cut on |r|.
HIGH_CORRELATION = 0.7


FEW_COLUMNS = 12
MAX_COLUMNS = 2_000     # a task holds five columns x columns matrices
GRAM = ("n", "sx", "sy", "sxx", "syy", "sxy")


def corr_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG31: long (a, b, r) for every pair a < b in ``cols`` order."""
    if len(cols) > FEW_COLUMNS:
        return gram_pairs(df, cols)
    pairs = list(combinations(cols, 2))
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}")
                    for i, (a, b) in enumerate(pairs)])
    names = F.create_map(*[x for i, (a, b) in enumerate(pairs)
                           for x in (F.lit(f"p{i}"), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    long = wide.unpivot([], [f"p{i}" for i in range(len(pairs))], "pair", "r")
    return long.select(names[F.col("pair")]["a"].alias("col_a"), names[F.col("pair")]["b"].alias("col_b"), "r")


def gram_sums(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of every pair i < j of columns over the rows that have both, from one scan. Values
    are taken from a first guess of their mean (of a few rows), which keeps the sums small and cancels out of r."""
    if len(cols) > MAX_COLUMNS:
        raise ValueError(f"{len(cols)} columns, more than {MAX_COLUMNS}")
    p = len(cols)
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    few = values.limit(1_000).agg(*[F.coalesce(F.avg(F.nanvl(f"c{i}", F.lit(None))), F.lit(0.0)).alias(f"c{i}") for i in range(p)]).first()
    shift = np.array([few[f"c{i}"] for i in range(p)])
    shift[~np.isfinite(shift)] = 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = np.zeros((4, p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - shift
            have = ~np.isnan(x)
            x = np.where(have, x, 0.0)
            m = have.astype(float)
            n += m.T @ m
            sx += x.T @ m
            sxx += (x * x).T @ m
            sxy += x.T @ x
        for i in range(p - 1):
            j = slice(i + 1, p)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * (p - i - 1), pa.int32()), pa.array(range(i + 1, p), pa.int32())]
                + [pa.array(v) for v in (n[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j])], ["i", "j", *GRAM])

    part = values.mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in GRAM))
    return part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in GRAM])


def gram_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG31 for many columns: (col_a, col_b, r) as ``corr_pairs``; r is NULL where a side has no variance. NaN counts as
    missing."""
    g = gram_sums(df, cols)
    n = F.col("n")
    vx, vy = (F.col(f"s{v}{v}") - F.col(f"s{v}") * F.col(f"s{v}") / n for v in ("x", "y"))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    # rounding leaves a constant column a variance of some 1e-16 of its squares
    varies = (n > 1) & (vx > F.col("sxx") * 1e-13) & (vy > F.col("syy") * 1e-13)
    names = F.array(*[F.lit(c) for c in cols])
    r = F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy))))
    return g.select(names[F.col("i")].alias("col_a"), names[F.col("j")].alias("col_b"), r.alias("r"))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG31 as a full symmetric matrix in long form (diagonal = 1)."""
    p = corr_pairs(df, cols)
    diag = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "col_a string, col_b string, r double")
    return p.unionByName(p.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r")).unionByName(diag)


def corr_with_target(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """AG32: r of each feature with the target, |r|, rank by |r| then name."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    long = wide.unpivot([], cols, "feature", "r")
    return (long.withColumn("abs_r", F.abs("r"))
            .withColumn("rank", F.row_number().over(Window.orderBy(F.col("abs_r").desc(), F.col("feature")))))


def high_pairs(pairs: DataFrame, cut: float = HIGH_CORRELATION) -> DataFrame:
    """AG33: pairs with |r| > cut (each unordered pair once, a < b, S19)."""
    return pairs.where(F.abs("r") > cut)


def top_pairs(pairs: DataFrame, n: int = 10) -> DataFrame:
    """AG34: n most positive and n most negative pairs (ties by names)."""
    pos = Window.orderBy(F.col("r").desc(), "col_a", "col_b")
    neg = Window.orderBy(F.col("r").asc(), "col_a", "col_b")
    return (pairs.withColumn("pos_rank", F.row_number().over(pos))
            .withColumn("neg_rank", F.row_number().over(neg))
            .where((F.col("pos_rank") <= n) | (F.col("neg_rank") <= n)))
