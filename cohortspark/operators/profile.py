"""Profiling aggregations (AG1-AG30, AG35).

Each report is one (or a few) distributed aggregations whose result has one
row per column / class / bin, so nothing that grows with the row count is
collected. Exact quantiles go through ``exact_quantiles`` (bounded memory per
task); per-class statistics over a known, small class set use conditional
expressions instead of a group holding a whole class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.operators.quantiles import (
    class_quantile_table, exact_quantiles, present, quantile_table, sketch_table, to_long,
)
from cohortspark.operators.ranking import running_total
from cohortspark.session import cut_lineage, stored

# The percentile ladder and quartiles of the reference reports.
PERCENTILE_LADDER = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
QUARTILES = (0.25, 0.50, 0.75)
IQR_FACTOR = 1.5


def numeric_columns(df: DataFrame) -> list[str]:
    """PR7: numeric columns (booleans are not numeric, S12)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def feature_report(df: DataFrame, numeric: list[str], strings: list[str]) -> DataFrame:
    """PR7 / PR13: every feature column with its kind, its present and missing rows and its distinct values, from one scan."""
    cols = [*numeric, *strings]
    wide = df.agg(*[e for i, c in enumerate(cols) for e in (F.count(c).alias(f"n{i}"), F.count_if(F.col(c).isNull()).alias(f"m{i}"),
                                                            F.count_distinct(c).alias(f"d{i}"))])
    kinds = ["numeric"] * len(numeric) + ["string"] * len(strings)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"), F.col(f"n{i}").alias("n"),
                                                   F.col(f"m{i}").alias("n_missing"), F.col(f"d{i}").alias("n_distinct"))
                                          for i, (c, k) in enumerate(zip(cols, kinds))])))


def _from_rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def missing_report(df: DataFrame, cols: list[str] | None = None, only_missing: bool = False) -> DataFrame:
    """AG4: missing count and % per column from one pass, most missing first."""
    cols = cols or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot(["__n"], cols, "column_name", "n_missing")
    out = long.select("column_name", "n_missing",
                      (F.col("n_missing") / F.col("__n") * 100).alias("pct_missing"))
    if only_missing:
        out = out.where(F.col("n_missing") > 0)
    return out.orderBy(F.col("n_missing").desc(), "column_name")


def numeric_describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG1 + AG2: count, missing, mean, sample std, min, 25/50/75 %, max per column. The sketch pass of the
    quantiles carries the moments: two scans."""
    every = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("__g"), present(F.col(c)).alias("__v")) for c in cols])))
    sketch = stored(sketch_table(every, list(QUARTILES), ["__g"], moments=True), "describe-sketch")
    t = quantile_table(every, list(QUARTILES), sketch=sketch)
    q = t.groupBy(F.col("__g").alias("name")).agg(*[F.max(F.when(F.col("j") == j, F.col("q"))).alias(f"p{p}")
                                                    for j, p in enumerate((25, 50, 75))])
    return sketch.join(q, F.col("__g") == F.col("name"), "left").select(
        F.col("__g").alias("column_name"), "n", "n_missing", "mean", "std", F.col("least").alias("min"), "p25", "p50", "p75",
        F.col("greatest").alias("max"))


def percentile_ladder(df: DataFrame, cols: list[str], probs=PERCENTILE_LADDER) -> DataFrame:
    """AG9: exact percentiles as long rows (column, pct, value)."""
    qs = exact_quantiles(df, cols, list(probs))
    rows = [(c, int(round(p * 100)), v) for c in cols for p, v in zip(probs, qs[c])]
    return _from_rows(df, rows, "column_name string, pct int, value double")


def categorical_describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG3: count, unique, top (count desc, value asc), freq per column."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column_name", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("c"))
    # top = smallest (-count, value): an aggregate (partial per task), not a
    # window over a column's distinct values
    return counts.groupBy("column_name").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_unique"),
        F.min_by("value", F.struct(-F.col("c"), F.col("value"))).alias("top"), F.max("c").alias("freq"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """AG5 / AG29 / CL7: count and % of total per value (NULL kept as a value)."""
    counts = cut_lineage(df.groupBy(col).agg(F.count(F.lit(1)).alias("n")))
    # the total is one scalar summed from the counts: no second scan, no window over all distinct values
    total = counts.agg(F.sum("n")).first()[0]
    return counts.withColumn("pct", F.col("n") / F.lit(total) * 100)


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG6: distinct non-NULL values per column (exact). Every column is its own distinct aggregation over a scan of that
    column alone: several ``count_distinct`` in one aggregation would copy each row once per column, with all columns as key."""
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    out = None
    for c in cols:
        # the values of one column are distinct after the grouping, so their number is a plain count
        one = df.select(F.col(c).alias("__v")).groupBy("__v").agg(F.lit(1).alias("__one")).agg(
            F.lit(c).alias("column_name"), F.count("__v").alias("n_distinct"))
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(total).select("column_name", "n_distinct", (F.col("n_distinct") == F.col("__n")).alias("is_unique"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """AG6: keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def drop_duplicates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """AG7: the table without repeated rows (of ``cols``, where given)."""
    return df.dropDuplicates(cols) if cols else df.distinct()


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """AG7: fully repeated rows with their multiplicity (``dropDuplicates`` removes them)."""
    cols = cols or df.columns
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def histogram(df: DataFrame, col: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """AG27: equal-width histogram over [min, max] with the maximum folded
    into the last bin (S28), optionally split by class; plus bin edges."""
    st = df.agg(F.min(F.col(col).cast("double")).alias("lo"), F.max(F.col(col).cast("double")).alias("hi")).first()
    lo, hi = st["lo"], st["hi"]
    if lo is None:
        return _from_rows(df, [], f"bin int, {by + ' string, ' if by else ''}n bigint, lo double, hi double")
    width = (hi - lo) / bins if hi > lo else 1.0
    x = F.col(col).cast("double")
    b = F.when(x.isNotNull(), F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int") + 1, F.lit(bins)))
    keys = [b.alias("bin")] + ([F.col(by)] if by else [])
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("bin").isNotNull())
    return out.select("*", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lo"),
                      (F.lit(lo) + F.col("bin") * F.lit(width)).alias("hi"))


def class_quantiles(df: DataFrame, cols: list[str], by: str, probs) -> DataFrame:
    """Exact quantiles of each column within each class of the data: a row per class with one array of
    quantiles per column."""
    t = class_quantile_table(df, cols, by, list(probs))
    return t.groupBy(by).agg(*[F.max(F.when(F.col("column_name") == c, F.col("q"))).alias(c) for c in cols])


def box_stats(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """AG30: quartiles, 1.5 IQR fences, whisker ends (most extreme values inside the fences) and outlier
    counts per (column, class), for every class of the data."""
    t = class_quantile_table(df, cols, by, list(QUARTILES))
    q1, q3 = F.col("q")[0], F.col("q")[2]
    iqr = q3 - q1
    fences = t.select(F.col("column_name"), F.col(by).alias("__class"), q1.alias("q1"), F.col("q")[1].alias("median"), q3.alias("q3"),
                      iqr.alias("iqr"), (q1 - IQR_FACTOR * iqr).alias("__lo"), (q3 + IQR_FACTOR * iqr).alias("__hi"))
    rows = to_long(df, cols, by).join(fences.select(F.col("column_name").alias("__c"), F.col("__class").alias("__k"), "__lo", "__hi"),
                                      (F.col("__g") == F.col("__c")) & F.col("__by").eqNullSafe(F.col("__k")))
    v = F.col("__v")
    ends = rows.groupBy("__c", "__k").agg(
        F.min(F.when(v >= F.col("__lo"), v)).alias("whisker_lo"), F.max(F.when(v <= F.col("__hi"), v)).alias("whisker_hi"),
        F.count_if((v < F.col("__lo")) | (v > F.col("__hi"))).alias("n_outliers"), F.count(F.lit(1)).alias("n"))
    return fences.join(ends, (F.col("column_name") == F.col("__c")) & F.col("__class").eqNullSafe(F.col("__k"))).select(
        "column_name", F.col("__class").cast("string").alias("class"), "q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi",
        "n_outliers", "n")


def binary_counts_by_class(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """AG28: counts of each value of binary columns per class (one grouped count)."""
    long = df.select(F.col(by), *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [by], cols, "column_name", "value")
    return long.groupBy("column_name", "value", by).agg(F.count(F.lit(1)).alias("n"))


def group_means_pivot(df: DataFrame, cols: list[str], by: str, classes: list) -> DataFrame:
    """AG11: features x classes table of means (unpivot then pivot on known classes)."""
    long = df.select(F.col(by), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [by], cols, "column_name", "value")
    return long.groupBy("column_name").pivot(by, classes).agg(F.avg("value"))


def group_median_iqr(df: DataFrame, cols: list[str], by: str, overall: str = "Overall") -> DataFrame:
    """AG13 + FN7: 'median (q1-q3)' per (column, group) for every group of the data, plus an overall
    column; numbers are half-even rounded to one decimal before printing. Every row enters once for its
    group and once for the overall column, in one pass."""
    both = df.select(F.explode(F.array(F.col(by).cast("string"), F.lit(overall))).alias("grp"), *cols)
    t = class_quantile_table(both, cols, "grp", list(QUARTILES))
    return t.select("column_name", "grp", median_iqr_text(F.col("q")[1], F.col("q")[0], F.col("q")[2]).alias("summary"))


def median_iqr_text(med: Column, q1: Column, q3: Column) -> Column:
    """FN7: 'm (a–b)' with one decimal."""
    from cohortspark.functions.columns import round_half_even
    return F.format_string("%.1f (%.1f–%.1f)", round_half_even(med, 1), round_half_even(q1, 1),
                           round_half_even(q3, 1))


def crosstab(df: DataFrame, a: str, b: str, margin: str = "All") -> DataFrame:
    """AG15: counts of (a, b) with row / column / grand margins via CUBE,
    as long rows; AG16 row-normalised % added (share of the row total)."""
    cube = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    out = cube.select(
        F.when(F.col("g").bitwiseAND(2) == 2, F.lit(margin)).otherwise(F.col(a).cast("string")).alias(a),
        F.when(F.col("g").bitwiseAND(1) == 1, F.lit(margin)).otherwise(F.col(b).cast("string")).alias(b),
        "n")
    w = Window.partitionBy(a)
    row_total = F.max(F.when(F.col(b) == margin, F.col("n"))).over(w)
    return out.withColumn("row_pct", F.col("n") / row_total * 100)


def class_balance(df: DataFrame, label: str, positive=1) -> DataFrame:
    """AG20-AG22: per class count, share, balanced weight n / (k * n_c);
    majority / minority class, imbalance ratio and negative/positive ratio."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    n_all, k = F.sum("n").over(w), F.count(F.lit(1)).over(w)
    return (counts
            .withColumn("share", F.col("n") / n_all)
            .withColumn("balanced_weight", n_all / (k * F.col("n")))
            .withColumn("majority_class", F.first(F.col(label)).over(
                Window.orderBy(F.col("n").desc(), F.col(label)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            .withColumn("minority_class", F.first(F.col(label)).over(
                Window.orderBy(F.col("n").asc(), F.col(label)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            .withColumn("imbalance_ratio", F.max("n").over(w) / F.min("n").over(w))
            .withColumn("neg_pos_ratio", F.sum(F.when(F.col(label) != F.lit(positive), F.col("n"))).over(w)
                        / F.sum(F.when(F.col(label) == F.lit(positive), F.col("n"))).over(w)))


def balanced_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """AG22 / S25: add n / (k * n_c) as a row weight; the per-class table is
    k rows and is joined by broadcast (k is the class count, bounded)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    w = Window.partitionBy()
    weights = counts.select(label, (F.sum("__nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("__nc"))).alias(weight_col))
    return df.join(F.broadcast(weights), label, "left")


def stratified_sample(df: DataFrame, by: str, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """AG35: n rows per class, chosen by a seeded portable hash of the key.
    ``row_number() <= n`` is planned with a per-partition group limit before
    the shuffle, so a huge class ships at most n rows per partition."""
    h = portable_hash(key, seed)
    w = Window.partitionBy(by).orderBy(h, *[F.col(k) for k in key])
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def portable_hash(key: list[str], seed: int = 42) -> Column:
    """S13: first 8 hex digits of md5('seed:k1:k2...') as a bigint; the same
    value is computed by DuckDB with ('0x' || substr(md5(..),1,8))::BIGINT."""
    txt = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(txt), 1, 8), 16, 10).cast("bigint")


def rank_within_group(df: DataFrame, group: list[str], order: list[Column], out: str = "rank",
                      partitions: int | None = None) -> DataFrame:
    """Row number within each group (NULL is a group) in the given order, without putting a whole group in
    one task (``running_total`` of ones)."""
    ranked = running_total(df, group, order, F.lit(1).cast("long"), out, partitions)
    return ranked.withColumn(out, F.col(out).cast("int"))
