"""Profiling and correlation queries (AG*, SC6) on lineitem / orders."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from cohortspark.operators import correlation as co
from cohortspark.operators import profile as pf
from cohortspark.plans.common import LI_NUMERIC, LI_TARGET, lineitem_with_gaps, r6, t
from cohortspark.plans.registry import register

CLASSES = ["A", "N", "R"]
GAPS_SQL = ("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
            "CASE WHEN l_tax <> 0.0 THEN l_quantity END AS l_quantity, "
            "CASE WHEN l_discount <> 0.1 THEN l_extendedprice END AS l_extendedprice, "
            "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _union(parts):
    return " UNION ALL ".join(parts)


# ---------------------------------------------------------------- AG4
@register("missing_report", "AG4 PR12", sql=_union(
    f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS n_missing, "
    f"round_even(count_if({c} IS NULL) * 100.0 / count(*), 6) AS pct_missing FROM ({GAPS_SQL}) s"
    for c in LI_COLS))
def missing_report(spark, d):
    m = pf.missing_report(lineitem_with_gaps(spark, d), LI_COLS)
    return m.select("column_name", "n_missing", r6("pct_missing").alias("pct_missing"))


# ---------------------------------------------------------------- AG1 / AG2
@register("numeric_describe", "AG1 AG2 AG8 S1 S3", sql=_union(
    f"SELECT '{c}' AS column_name, count({c}) AS n, count_if({c} IS NULL) AS n_missing, "
    f"round_even(avg({c}), 6) AS mean, round_even(stddev_samp({c}), 6) AS std, "
    f"round_even(min({c}), 6) AS min, round_even(quantile_cont({c}, 0.25), 6) AS p25, "
    f"round_even(quantile_cont({c}, 0.5), 6) AS p50, round_even(quantile_cont({c}, 0.75), 6) AS p75, "
    f"round_even(max({c}), 6) AS max FROM ({GAPS_SQL}) s" for c in LI_NUMERIC))
def numeric_describe(spark, d):
    x = pf.numeric_describe(lineitem_with_gaps(spark, d), LI_NUMERIC)
    return x.select("column_name", "n", "n_missing",
                    *[r6(c).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


# ---------------------------------------------------------------- AG9
@register("percentile_ladder", "AG9 AG8", sql=_union(
    f"SELECT '{c}' AS column_name, {int(round(p * 100))}::INTEGER AS pct, "
    f"round_even(quantile_cont({c}, {p}), 6) AS value FROM lineitem"
    for c in LI_NUMERIC for p in pf.PERCENTILE_LADDER))
def percentile_ladder(spark, d):
    x = pf.percentile_ladder(t(spark, d, "lineitem"), LI_NUMERIC)
    return x.select("column_name", "pct", r6("value").alias("value"))


# ---------------------------------------------------------------- AG3
_CAT = ["o_orderstatus", "o_orderpriority"]


@register("categorical_describe", "AG3 S27", sql=_union(
    f"""SELECT '{c}' AS column_name, sum(n) AS n, count(*) AS n_unique,
        arg_min(v, (-n, v)) AS top, max(n) AS freq
        FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1)"""
    for c in _CAT).replace("sum(n) AS n", "CAST(sum(n) AS BIGINT) AS n"))
def categorical_describe(spark, d):
    return pf.categorical_describe(t(spark, d, "orders"), _CAT)


# ---------------------------------------------------------------- AG5
@register("value_counts", "AG5 WN4", sql=(
    "SELECT o_orderpriority, count(*) AS n, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct "
    "FROM orders GROUP BY 1"))
def value_counts(spark, d):
    v = pf.value_counts(t(spark, d, "orders"), "o_orderpriority")
    return v.select("o_orderpriority", "n", r6("pct").alias("pct"))


# ---------------------------------------------------------------- AG6
@register("distinct_counts", "AG6", sql=_union(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, "
    f"count(DISTINCT {c}) = count(*) AS is_unique FROM lineitem" for c in LI_COLS))
def distinct_counts(spark, d):
    return pf.distinct_counts(t(spark, d, "lineitem"), LI_COLS)


@register("repeated_keys", "AG6", sql=(
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"))
def repeated_keys(spark, d):
    return pf.repeated_keys(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- AG7
@register("duplicate_rows", "AG7", sql=(
    "SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n FROM orders "
    "GROUP BY ALL HAVING count(*) > 1"))
def duplicate_rows(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return pf.duplicate_rows(o)


@register("duplicate_summary", "AG7", sql=(
    "SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus, "
    "o_orderpriority FROM orders)) AS n_distinct_rows FROM orders"))
def duplicate_summary(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    # distinct over the row struct counts the rows dropDuplicates() would keep (NULL fields included)
    return o.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_distinct(F.struct(*o.columns)).alias("n_distinct_rows"))


# ---------------------------------------------------------------- SC6
@register("table_shape", "SC6", sql=f"SELECT count(*) AS n_rows, CAST({len(LI_COLS)} AS BIGINT) AS n_columns FROM lineitem")
def table_shape(spark, d):
    from cohortspark.sources import shape_frame
    return shape_frame(t(spark, d, "lineitem"))


# ---------------------------------------------------------------- AG27
@register("histogram_by_class", "AG27 S28", sql="""
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 30)) AS INTEGER) + 1, 30) AS bin,
             l_returnflag, lo, (hi - lo) / 30 AS w FROM lineitem, s)
SELECT bin, l_returnflag, count(*) AS n, round_even(any_value(lo) + (bin - 1) * any_value(w), 6) AS lo,
       round_even(any_value(lo) + bin * any_value(w), 6) AS hi FROM b GROUP BY bin, l_returnflag""")
def histogram_by_class(spark, d):
    h = pf.histogram(t(spark, d, "lineitem"), "l_extendedprice", 30, by=LI_TARGET)
    return h.select("bin", LI_TARGET, "n", r6("lo").alias("lo"), r6("hi").alias("hi"))


@register("histogram_marks", "AG27 AG12", sql="""
SELECT l_returnflag, count(l_extendedprice) AS n, round_even(avg(l_extendedprice), 6) AS mean,
       round_even(quantile_cont(l_extendedprice, 0.5), 6) AS median FROM lineitem GROUP BY 1""")
def histogram_marks(spark, d):
    """The mean and median marks drawn over each class's histogram."""
    li = t(spark, d, "lineitem")
    med = pf.class_quantiles(li, ["l_extendedprice"], LI_TARGET, [0.5]).select(
        F.col(LI_TARGET).alias("k"), F.col("l_extendedprice")[0].alias("median"))
    m = li.groupBy(LI_TARGET).agg(F.count("l_extendedprice").alias("n"), F.avg("l_extendedprice").alias("mean"))
    return m.join(med, F.col(LI_TARGET).eqNullSafe(F.col("k"))).select(LI_TARGET, "n", r6("mean").alias("mean"), r6("median").alias("median"))


# ---------------------------------------------------------------- SC1 SC4 SC6
@register("csv_round_trip", "SC1 SC4", sql="SELECT s_suppkey, s_nationkey, round_even(s_acctbal, 2) AS s_acctbal FROM supplier")
def csv_round_trip(spark, d):
    """Write the table as CSV with a header and read it back by an explicit schema."""
    import uuid
    from cohortspark.session import checkpoint_dir
    from cohortspark.sources import read_any, write_table
    src = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}/supplier.csv"
    write_table(src, path, "csv")
    return read_any(spark, path, src.schema).select("s_suppkey", "s_nationkey", r6("s_acctbal", 2).alias("s_acctbal"))


@register("schema_report", "SC6 AG4", sql=" UNION ALL ".join(
    f"SELECT {i}::INTEGER AS position, '{c}' AS column_name, '{k}' AS data_type, count(*) AS n_rows, count_if({c} IS NULL) AS n_missing FROM orders"
    for i, (c, k) in enumerate([("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double")])))
def schema_report(spark, d):
    """Position, name and type of every column with its row and missing counts (numbers and texts alike)."""
    from cohortspark.sources import schema_frame
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    counts = pf.missing_report(o).select(F.col("column_name").alias("c"), "n_missing")
    n = o.agg(F.count(F.lit(1)).alias("n_rows"))
    return (schema_frame(o).join(counts, F.col("column_name") == F.col("c")).withColumn("n_rows", F.lit(n.first()[0]))
            .select("position", "column_name", "data_type", "n_rows", "n_missing"))


# ---------------------------------------------------------------- AG30
def _box_sql(cols, by, classes):
    parts = []
    for c in cols:
        for k in classes:
            parts.append(f"""SELECT '{c}' AS column_name, '{k}' AS class, round_even(q1, 6) AS q1,
   round_even(med, 6) AS median, round_even(q3, 6) AS q3, round_even(q3 - q1, 6) AS iqr,
   round_even(min({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
   round_even(max({c}) FILTER (WHERE {c} <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
   count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers, count({c}) AS n
FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med,
   quantile_cont({c}, 0.75) AS q3 FROM lineitem WHERE {by} = '{k}') q WHERE {by} = '{k}'
GROUP BY q1, med, q3""")
    return _union(parts)


@register("box_stats", "AG30 OU1", sql=_box_sql(["l_quantity", "l_extendedprice"], LI_TARGET, CLASSES))
def box_stats(spark, d):
    b = pf.box_stats(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], LI_TARGET)
    return b.select("column_name", "class", *[r6(c).alias(c) for c in
                    ["q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi"]], "n_outliers", "n")


# ---------------------------------------------------------------- AG28
@register("binary_counts_by_class", "AG28", sql=(
    "SELECT column_name, value, l_returnflag, count(*) AS n FROM ("
    "SELECT 'l_linestatus' AS column_name, l_linestatus AS value, l_returnflag FROM lineitem UNION ALL "
    "SELECT 'high_discount', CAST((l_discount > 0.05)::INTEGER AS VARCHAR), l_returnflag FROM lineitem) "
    "GROUP BY ALL"))
def binary_counts_by_class(spark, d):
    li = t(spark, d, "lineitem").withColumn("high_discount", (F.col("l_discount") > 0.05).cast("int"))
    return pf.binary_counts_by_class(li, ["l_linestatus", "high_discount"], LI_TARGET)


# ---------------------------------------------------------------- AG11
@register("group_means_pivot", "AG11", sql=_union(
    f"SELECT '{c}' AS column_name, " + ", ".join(
        f"round_even(avg({c}) FILTER (WHERE l_returnflag = '{k}'), 6) AS {k}" for k in CLASSES)
    + " FROM lineitem" for c in LI_NUMERIC))
def group_means_pivot(spark, d):
    p = pf.group_means_pivot(t(spark, d, "lineitem"), LI_NUMERIC, LI_TARGET, CLASSES)
    return p.select("column_name", *[r6(k).alias(k) for k in CLASSES])


# ---------------------------------------------------------------- AG13 / FN7
def _miqr_sql(cols, by, classes):
    def fmt(where):
        return (f"printf('%.1f (%.1f–%.1f)', round_even(quantile_cont(x, 0.5), 1), "
                f"round_even(quantile_cont(x, 0.25), 1), round_even(quantile_cont(x, 0.75), 1))")
    parts = []
    for c in cols:
        for k in classes:
            parts.append(f"SELECT '{c}' AS column_name, '{k}' AS grp, {fmt(None)} AS summary "
                         f"FROM (SELECT {c} AS x FROM lineitem WHERE {by} = '{k}')")
        parts.append(f"SELECT '{c}' AS column_name, 'Overall' AS grp, {fmt(None)} AS summary "
                     f"FROM (SELECT {c} AS x FROM lineitem)")
    return _union(parts)


@register("group_median_iqr", "AG13 AG12 FN7 UD3", sql=_miqr_sql(["l_quantity", "l_extendedprice", "l_discount"],
                                                             LI_TARGET, CLASSES))
def group_median_iqr(spark, d):
    return pf.group_median_iqr(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"],
                               LI_TARGET)


# ---------------------------------------------------------------- AG15 / AG16
@register("crosstab_margins", "AG15 AG16", sql="""
WITH c AS (SELECT coalesce(l_returnflag, 'All') AS l_returnflag, coalesce(l_linestatus, 'All') AS l_linestatus,
                  count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus))
SELECT l_returnflag, l_linestatus, n,
       round_even(n * 100.0 / max(CASE WHEN l_linestatus = 'All' THEN n END) OVER (PARTITION BY l_returnflag), 6)
         AS row_pct FROM c""")
def crosstab_margins(spark, d):
    x = pf.crosstab(t(spark, d, "lineitem"), LI_TARGET, "l_linestatus")
    return x.select(LI_TARGET, "l_linestatus", "n", r6("row_pct").alias("row_pct"))


# ---------------------------------------------------------------- AG20-22
@register("class_balance", "AG20 AG21 AG22 AG29", sql="""
WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, round_even(n / sum(n) OVER (), 6) AS share,
       round_even(sum(n) OVER () / (count(*) OVER () * n), 6) AS balanced_weight,
       first(l_returnflag ORDER BY n DESC, l_returnflag) OVER (ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS majority_class,
       first(l_returnflag ORDER BY n ASC, l_returnflag) OVER (ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS minority_class,
       round_even(max(n) OVER () / min(n) OVER (), 6) AS imbalance_ratio,
       round_even(sum(n) FILTER (WHERE l_returnflag <> 'R') OVER () / sum(n) FILTER (WHERE l_returnflag = 'R') OVER (), 6)
         AS neg_pos_ratio FROM c""")
def class_balance(spark, d):
    b = pf.class_balance(t(spark, d, "lineitem"), LI_TARGET, positive="R")
    return b.select(LI_TARGET, "n", *[r6(c).alias(c) for c in ["share", "balanced_weight"]],
                    "majority_class", "minority_class",
                    *[r6(c).alias(c) for c in ["imbalance_ratio", "neg_pos_ratio"]])


# ---------------------------------------------------------------- AG35
@register("scatter_sample", "AG35 S13", sql="""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus
     ORDER BY ('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT, o_orderkey) AS rn
  FROM orders) WHERE rn <= 50""")
def scatter_sample(spark, d):
    s = pf.stratified_sample(t(spark, d, "orders"), "o_orderstatus", 50, ["o_orderkey"], seed=42)
    return s.select("o_orderkey", "o_orderstatus", "o_totalprice")


# ---------------------------------------------------------------- AG31-34
_CORR_SRC = ("SELECT l_quantity, l_extendedprice, l_discount, l_tax, "
             "l_extendedprice * (1 - l_discount) AS net_price, "
             "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, "
             "(l_returnflag = 'R')::INTEGER AS is_returned FROM lineitem")
_CORR_COLS = LI_NUMERIC + ["net_price", "charge"]


def _corr_frame(spark, d):
    li = t(spark, d, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select(*LI_NUMERIC, net.alias("net_price"), (net * (1 + F.col("l_tax"))).alias("charge"),
                     (F.col(LI_TARGET) == "R").cast("int").alias("is_returned"))


_PAIRS_SQL = _union(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM ({_CORR_SRC})"
                    for a, b in combinations(_CORR_COLS, 2))


@register("corr_matrix", "AG31", sql=f"""
WITH p AS ({_PAIRS_SQL})
SELECT col_a, col_b, round_even(r, 6) AS r FROM p UNION ALL
SELECT col_b, col_a, round_even(r, 6) FROM p UNION ALL
SELECT * FROM (VALUES {', '.join(f"('{c}', '{c}', 1.0::DOUBLE)" for c in _CORR_COLS)}) v(col_a, col_b, r)""")
def corr_matrix(spark, d):
    m = co.corr_matrix(_corr_frame(spark, d), _CORR_COLS)
    return m.select("col_a", "col_b", r6("r").alias("r"))


_DIMS = 64
# gaps by value, so that every pair of columns has rows of its own
_GAPPY = [f"CASE WHEN embedding[{i + 1}] > -0.2 THEN embedding[{i + 1}]::DOUBLE END AS e{i}" for i in range(_DIMS)]


@register("corr_wide", "AG31 AG33", sql=f"""
WITH w AS (SELECT {', '.join(_GAPPY)} FROM embeddings),
c AS (SELECT {', '.join(f'corr(e{i}, e{j}) AS p{i}_{j}' for i, j in combinations(range(_DIMS), 2))} FROM w),
u AS (UNPIVOT c ON COLUMNS(*) INTO NAME pair VALUE r)
SELECT 'e' || split_part(pair[2:], '_', 1) AS col_a, 'e' || split_part(pair, '_', 2) AS col_b, round_even(r, 6) AS r FROM u""")
def corr_wide(spark, d):
    """All pairs of the 64 columns of the embeddings, pairwise complete, from one scan of packed Gram sums."""
    e = t(spark, d, "embeddings")
    v = [F.col("embedding")[i].cast("double") for i in range(_DIMS)]
    x = e.select(*[F.when(c > F.lit(-0.2).cast("float"), c).alias(f"e{i}") for i, c in enumerate(v)])
    return co.corr_pairs(x, [f"e{i}" for i in range(_DIMS)]).select("col_a", "col_b", r6("r").alias("r"))


@register("corr_target", "AG32 WN7", sql=f"""
WITH c AS ({_union(f"SELECT '{c}' AS feature, corr({c}, is_returned) AS r FROM ({_CORR_SRC})" for c in _CORR_COLS)})
SELECT feature, round_even(r, 6) AS r, round_even(abs(r), 6) AS abs_r,
       CAST(row_number() OVER (ORDER BY abs(r) DESC, feature) AS INTEGER) AS rank FROM c""")
def corr_target(spark, d):
    c = co.corr_with_target(_corr_frame(spark, d), _CORR_COLS, "is_returned")
    return c.select("feature", r6("r").alias("r"), r6("abs_r").alias("abs_r"), "rank")


@register("corr_high_pairs", "AG33 S19", sql=f"""
SELECT col_a, col_b, round_even(r, 6) AS r FROM ({_PAIRS_SQL}) WHERE abs(r) > 0.7""")
def corr_high_pairs(spark, d):
    p = co.high_pairs(co.corr_pairs(_corr_frame(spark, d), _CORR_COLS))
    return p.select("col_a", "col_b", r6("r").alias("r"))


@register("corr_top_pairs", "AG34 WN6", sql=f"""
SELECT col_a, col_b, round_even(r, 6) AS r,
       CAST(pos_rank AS INTEGER) AS pos_rank, CAST(neg_rank AS INTEGER) AS neg_rank FROM (
  SELECT *, row_number() OVER (ORDER BY r DESC, col_a, col_b) AS pos_rank,
            row_number() OVER (ORDER BY r ASC, col_a, col_b) AS neg_rank FROM ({_PAIRS_SQL}))
WHERE pos_rank <= 3 OR neg_rank <= 3""")
def corr_top_pairs(spark, d):
    p = co.top_pairs(co.corr_pairs(_corr_frame(spark, d), _CORR_COLS), n=3)
    return p.select("col_a", "col_b", r6("r").alias("r"), "pos_rank", "neg_rank")


# ---------------------------------------------------------------- SC2 SC5 PR2 PR3
@register("cohort_load", "SC2 SC5 PR1 PR2 PR3 PR4", sql=(
    "SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount, "
    "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem"))
def cohort_load(spark, d):
    from cohortspark.sources import load_cohort, resolve_target
    li = t(spark, d, "lineitem").drop("l_comment", "l_shipdate", "l_linestatus")
    target = resolve_target(li, ["diabetes_status", "l_returnflag"])
    c = load_cohort(li, ["l_quantity", "l_extendedprice", "l_discount"], target, positive_value="R")
    return c.withColumnsRenamed({"l_quantity": "quantity", "l_extendedprice": "price"})


# Display names for the report columns.
DISPLAY = {"l_quantity": "Quantity", "l_extendedprice": "Extended price", "l_discount": "Discount", "l_tax": "Tax"}


@register("describe_display", "FN8 AG1", sql=" UNION ALL ".join(
    f"SELECT '{DISPLAY[c]}' AS display_name, round_even(avg({c}), 6) AS mean, round_even(min({c}), 6) AS min, "
    f"round_even(max({c}), 6) AS max FROM lineitem" for c in LI_NUMERIC))
def describe_display(spark, d):
    from cohortspark.functions.columns import display_names
    li = t(spark, d, "lineitem")
    wide = li.agg(*[e for c in LI_NUMERIC for e in (F.avg(c).alias(f"{c}__mean"), F.min(c).alias(f"{c}__min"),
                                                     F.max(c).alias(f"{c}__max"))])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__mean").alias("mean"),
                                                    F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"))
                                           for c in LI_NUMERIC])).alias("s")).select("s.*")
    return long.select(display_names("column_name", DISPLAY).alias("display_name"),
                       *[r6(c).alias(c) for c in ["mean", "min", "max"]])
