"""Leakage-audit and outlier queries (AG17, AG23-AG26, FN3, PR16, OU1-OU4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import leakage as lk
from cohortspark.operators import outliers as ou
from cohortspark.plans.common import LI_NUMERIC, LI_TARGET, r6, t
from cohortspark.plans.registry import register

RULES = {"l_quantity": 25.0, "l_discount": 0.05}
_LBL_SRC = "SELECT *, (l_returnflag = 'R')::INTEGER AS is_returned FROM lineitem"


def _labelled(spark, d):
    return t(spark, d, "lineitem").withColumn("is_returned", (F.col(LI_TARGET) == "R").cast("int"))


def _union(parts):
    return " UNION ALL ".join(parts)


@register("rule_share_by_class", "AG23", sql=_union(
    f"SELECT '{f}' AS feature, is_returned, round_even(avg({f}), 6) AS mean, round_even(min({f}), 6) AS min, "
    f"round_even(max({f}), 6) AS max, round_even(count_if({f} >= {v}) * 100.0 / count(*), 6) AS pct_at_or_above "
    f"FROM ({_LBL_SRC}) GROUP BY is_returned" for f, v in RULES.items()))
def rule_share_by_class(spark, d):
    r = lk.class_threshold_report(_labelled(spark, d), "is_returned", RULES)
    return r.select("feature", "is_returned", *[r6(c).alias(c) for c in ["mean", "min", "max", "pct_at_or_above"]])


@register("rule_accuracy", "AG24 PR14", sql=_union(
    f"SELECT '{f}' AS feature, {v}::DOUBLE AS threshold, round_even(avg((coalesce(({f} >= {v})::INTEGER, 0) = is_returned)::INTEGER), 6) AS accuracy, "
    f"avg((coalesce(({f} >= {v})::INTEGER, 0) = is_returned)::INTEGER) >= 0.95 AS alert FROM ({_LBL_SRC})"
    for f, v in RULES.items()))
def rule_accuracy(spark, d):
    r = lk.rule_accuracy(_labelled(spark, d), "is_returned", RULES)
    return r.select("feature", "threshold", r6("accuracy").alias("accuracy"), "alert")


@register("range_overlap", "AG25", sql=_union(f"""
SELECT '{f}' AS feature, round_even(a, 6) AS pos_min, round_even(b, 6) AS pos_max, round_even(c, 6) AS neg_min,
       round_even(dd, 6) AS neg_max, round_even(greatest(a, c), 6) AS overlap_lo, round_even(least(b, dd), 6) AS overlap_hi,
       round_even(CASE WHEN least(b, dd) > greatest(a, c)
            THEN (SELECT count_if({f} BETWEEN greatest(a, c) AND least(b, dd)) FROM lineitem) * 100.0 / (SELECT count(*) FROM lineitem)
            ELSE 0 END, 6) AS overlap_pct
FROM (SELECT min({f}) FILTER (WHERE is_returned = 1) AS a, max({f}) FILTER (WHERE is_returned = 1) AS b,
             min({f}) FILTER (WHERE is_returned = 0) AS c, max({f}) FILTER (WHERE is_returned = 0) AS dd FROM ({_LBL_SRC}))"""
    for f in LI_NUMERIC))
def range_overlap(spark, d):
    r = lk.range_overlap(_labelled(spark, d), "is_returned", LI_NUMERIC)
    return r.select("feature", *[r6(c).alias(c) for c in
                                 ["pos_min", "pos_max", "neg_min", "neg_max", "overlap_lo", "overlap_hi", "overlap_pct"]])


_T_SQL = _union(f"""
SELECT '{f}' AS feature, n1, n0, (m1 - m0) / sqrt((((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) * (1.0 / n1 + 1.0 / n0)) AS t,
       CAST(n1 + n0 - 2 AS BIGINT) AS dof
FROM (SELECT count_if(is_returned = 1 AND {f} IS NOT NULL) AS n1, count_if(is_returned = 0 AND {f} IS NOT NULL) AS n0,
             avg({f}) FILTER (WHERE is_returned = 1) AS m1, avg({f}) FILTER (WHERE is_returned = 0) AS m0,
             var_samp({f}) FILTER (WHERE is_returned = 1) AS v1, var_samp({f}) FILTER (WHERE is_returned = 0) AS v0
      FROM ({_LBL_SRC}))""" for f in LI_NUMERIC)


@register("t_statistic", "AG26 S17", sql=f"SELECT feature, n1, n0, round_even(t, 6) AS t, dof FROM ({_T_SQL})")
def t_statistic(spark, d):
    r = lk.t_statistics(_labelled(spark, d), "is_returned", LI_NUMERIC)
    return r.select("feature", "n1", "n0", r6("t").alias("t"), "dof")


@register("t_test_pvalue", "AG26 S17")
def t_test_pvalue(spark, d):
    """Rows-only: DuckDB has no Student-t CDF; tested against a numeric
    integration in tests/test_units.py."""
    r = lk.t_statistics(_labelled(spark, d), "is_returned", LI_NUMERIC, with_p=True)
    return r.select("feature", r6("t").alias("t"), "dof", r6("p_value").alias("p_value"))


@register("decimal_places", "FN3", sql=_union(
    f"SELECT '{c}' AS column_name, CAST(max(CASE WHEN instr(CAST({c} AS VARCHAR), '.') > 0 "
    f"THEN length(split_part(CAST({c} AS VARCHAR), '.', -1)) ELSE 0 END) AS INTEGER) AS max_places, "
    f"round_even(avg(CASE WHEN instr(CAST({c} AS VARCHAR), '.') > 0 "
    f"THEN length(split_part(CAST({c} AS VARCHAR), '.', -1)) ELSE 0 END), 6) AS mean_places FROM lineitem"
    for c in LI_NUMERIC))
def decimal_places(spark, d):
    r = lk.decimal_places(t(spark, d, "lineitem"), LI_NUMERIC)
    return r.select("column_name", "max_places", r6("mean_places").alias("mean_places"))


_CHECKS_SQL = _union(
    [f"SELECT 'rule_accuracy:{f}' AS check_name, round_even(avg((coalesce(({f} >= {v})::INTEGER, 0) = is_returned)::INTEGER), 6) AS value, "
     f"avg((coalesce(({f} >= {v})::INTEGER, 0) = is_returned)::INTEGER) >= 0.95 AS flagged FROM ({_LBL_SRC})"
     for f, v in RULES.items()]
    + ["SELECT 'all_rows_positive_quantity', CAST(bool_and(l_quantity > 0)::INTEGER AS DOUBLE), "
       "bool_and(l_quantity > 0) FROM lineitem"])


def _checks(spark, d):
    li = _labelled(spark, d)
    acc = lk.rule_accuracy(li, "is_returned", RULES)
    rules = acc.select(F.concat(F.lit("rule_accuracy:"), F.col("feature")).alias("check_name"),
                       r6("accuracy").alias("value"), F.col("alert").alias("flagged"))
    allpos = lk.all_true(li.withColumn("positive_quantity", F.col("l_quantity") > 0), "positive_quantity")
    flag = allpos.select(F.lit("all_rows_positive_quantity").alias("check_name"),
                         F.col("all_positive_quantity").cast("int").cast("double").alias("value"),
                         F.col("all_positive_quantity").alias("flagged"))
    return rules.unionByName(flag)


@register("leakage_checks", "PR16 AG17 AG24", sql=_CHECKS_SQL)
def leakage_checks(spark, d):
    return _checks(spark, d)


@register("leakage_issues", "PR16", sql=f"SELECT * FROM ({_CHECKS_SQL}) WHERE flagged")
def leakage_issues(spark, d):
    return lk.issue_list(_checks(spark, d))


# ---------------------------------------------------------------- OU1
@register("iqr_outliers", "OU1", sql=_union(f"""
SELECT '{c}' AS column_name, round_even(q1, 6) AS q1, round_even(q3, 6) AS q3, round_even(q1 - 1.5 * (q3 - q1), 6) AS lower,
       round_even(q3 + 1.5 * (q3 - q1), 6) AS upper,
       (SELECT count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) FROM lineitem) AS n_outliers,
       round_even((SELECT count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) FROM lineitem) * 100.0
                  / (SELECT count(*) FROM lineitem), 6) AS pct
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""" for c in LI_NUMERIC + ["charge"]
).replace("FROM lineitem", "FROM (SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem)"))
def iqr_outliers(spark, d):
    li = t(spark, d, "lineitem").withColumn(
        "charge", F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    r = ou.iqr_outliers(li, LI_NUMERIC + ["charge"])
    return r.select("column_name", *[r6(c).alias(c) for c in ["q1", "q3", "lower", "upper"]], "n_outliers",
                    r6("pct").alias("pct"))


# ---------------------------------------------------------------- OU2
RANGES = {"l_quantity": (2, 48), "l_discount": (0.01, 0.09), "l_tax": (0.0, 0.07)}


@register("range_violations", "OU2", sql=_union(
    f"SELECT '{c}' AS column_name, {lo}::DOUBLE AS low, {hi}::DOUBLE AS high, count_if({c} < {lo}) AS n_below, "
    f"count_if({c} > {hi}) AS n_above FROM lineitem" for c, (lo, hi) in RANGES.items()))
def range_violations(spark, d):
    return ou.range_violations(t(spark, d, "lineitem"), RANGES)


@register("range_clip", "OU2 FN6 S8 S22 JN5", sql=(
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    + ", ".join(f"round_even(CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END, 6) AS {c}"
                for c, (lo, hi) in RANGES.items()) + " FROM lineitem"))
def range_clip(spark, d):
    c = ou.range_clip(t(spark, d, "lineitem"), RANGES)
    return c.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[r6(k).alias(k) for k in RANGES])


# ---------------------------------------------------------------- OU3
_WIN = ["l_quantity", "l_extendedprice", "l_tax"]


@register("winsorise_flagged", "OU3 PR10 S18 JN5", sql=f"""
WITH q AS (SELECT {', '.join(f"quantile_cont({c}, 0.05) AS lo_{c}, quantile_cont({c}, 0.95) AS hi_{c}" for c in _WIN)} FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity > 45 AS has_outlier,
       {', '.join(f"round_even(CASE WHEN l_quantity > 45 THEN (CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END) ELSE {c} END, 6) AS {c}" for c in _WIN)}
FROM lineitem, q""")
def winsorise_flagged(spark, d):
    li = t(spark, d, "lineitem").withColumn("has_outlier", F.col("l_quantity") > 45)
    w = ou.winsorise_flagged(li, _WIN, "has_outlier")
    return w.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "has_outlier", *[r6(c).alias(c) for c in _WIN])
