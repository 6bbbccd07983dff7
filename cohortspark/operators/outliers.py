"""Outlier counting and treatment (OU1-OU4).

Bounds are a few numbers per column computed by bounded aggregations
(``exact_quantiles``) and applied as literals in ONE projection, so the row
data is never shuffled for treatment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import clip
from cohortspark.operators.quantiles import exact_quantiles

IQR_FACTOR = 1.5


def iqr_bounds(df: DataFrame, cols: list[str], factor: float = IQR_FACTOR) -> dict[str, tuple]:
    qs = exact_quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c in cols:
        q1, q3 = qs[c]
        if q1 is None:
            out[c] = (None, None, None, None)
        else:
            iqr = q3 - q1
            out[c] = (q1, q3, q1 - factor * iqr, q3 + factor * iqr)
    return out


def iqr_outliers(df: DataFrame, cols: list[str], factor: float = IQR_FACTOR) -> DataFrame:
    """OU1: per column q1, q3, fences, outlier count and % of all rows."""
    b = iqr_bounds(df, cols, factor)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        _, _, lo, hi = b[c]
        x = F.col(c).cast("double")
        aggs.append(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"o{i}") if lo is not None
                    else F.lit(0).cast("bigint").alias(f"o{i}"))
    r = df.agg(*aggs).first()
    rows = [(c, *b[c], r[f"o{i}"], r[f"o{i}"] / r["__n"] * 100.0) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, q1 double, q3 double, lower double, upper double, n_outliers bigint, pct double")


def range_violations(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """OU2 (report): rows below / above each allowed range, one pass."""
    cols = [c for c in ranges if c in df.columns]
    aggs = [e for c in cols for e in (
        F.count_if(F.col(c) < F.lit(ranges[c][0])).alias(f"{c}__below"),
        F.count_if(F.col(c) > F.lit(ranges[c][1])).alias(f"{c}__above"))]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(float(ranges[c][0])).alias("low"),
                 F.lit(float(ranges[c][1])).alias("high"), F.col(f"{c}__below").alias("n_below"),
                 F.col(f"{c}__above").alias("n_above")) for c in cols])).alias("s")).select("s.*")


def range_clip(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """OU2 (treatment): clip every row into range; NULL stays NULL (S8, S22)."""
    return df.withColumns({c: clip(F.col(c), lo, hi) for c, (lo, hi) in ranges.items() if c in df.columns})


def winsorise_flagged(df: DataFrame, cols: list[str], flag: str, lo_q: float = 0.05, hi_q: float = 0.95,
                      fit: DataFrame | None = None) -> DataFrame:
    """OU3: clip flagged rows to [p_lo, p_hi]; percentiles come from ``fit``
    (default: all rows, as the reference does — S18)."""
    qs = exact_quantiles(fit if fit is not None else df, cols, [lo_q, hi_q])
    mask = F.coalesce(F.col(flag), F.lit(False))
    return df.withColumns({c: F.when(mask, clip(F.col(c), qs[c][0], qs[c][1])).otherwise(F.col(c))
                           for c in cols if qs[c][0] is not None})


def clamp_with_train_bounds(df: DataFrame, cols: list[str], flag: str, split_col: str = "split",
                            train_value: str = "train", factor: float = IQR_FACTOR) -> tuple[DataFrame, dict]:
    """OU4: IQR fences fitted on UNFLAGGED training rows, applied to the
    flagged rows of every split. Returns (treated frame, bounds)."""
    clean_train = df.where((F.col(split_col) == train_value) & ~F.coalesce(F.col(flag), F.lit(False)))
    b = iqr_bounds(clean_train, cols, factor)
    mask = F.coalesce(F.col(flag), F.lit(False))
    out = df.withColumns({c: F.when(mask, clip(F.col(c), b[c][2], b[c][3])).otherwise(F.col(c))
                          for c in cols if b[c][2] is not None})
    return out, b
