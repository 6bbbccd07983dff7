"""Entropy / information-gain queries on lineitem (target l_returnflag)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import entropy as en
from cohortspark.plans.common import LI_CATEGORICAL, LI_NUMERIC, LI_TARGET, r6, t
from cohortspark.plans.registry import register
from cohortspark.plans.sqlgen import ig_sql, qcut_bins_sql, unpivot_sql

_FEATS = LI_NUMERIC + LI_CATEGORICAL
_TYPES = {**{c: "numeric" for c in LI_NUMERIC}, **{c: "categorical" for c in LI_CATEGORICAL}}
_LI_SRC = f"SELECT {', '.join(_FEATS)}, {LI_TARGET} FROM lineitem"


def _ig_out(ig):
    return ig.select("feature", "feature_type", r6("information_gain").alias("information_gain"),
                     r6("pct_base_entropy").alias("pct_base_entropy"), "rank")


@register("ig_ranking", "EN1 EN8 EN11 EN13 EN14 WN1", sql=ig_sql(
    unpivot_sql(qcut_bins_sql(_LI_SRC, LI_NUMERIC, 5, [LI_TARGET] + LI_CATEGORICAL), _FEATS, [LI_TARGET]),
    LI_TARGET, _TYPES))
def ig_ranking(spark, sf_dir):
    """Flagship: information gain of lineitem features for the return flag,
    numeric features in 5 exact quantile bins."""
    li = t(spark, sf_dir, "lineitem")
    return _ig_out(en.information_gain(li, LI_TARGET, LI_NUMERIC, LI_CATEGORICAL, bins=5))


# ---------------------------------------------------------------- EN2
@register("entropy_breakdown", "EN2 EN1", sql="""
SELECT l_returnflag, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (), 6) AS p,
       round_even(-(count(*) / sum(count(*)) OVER ()) * log2(count(*) / sum(count(*)) OVER ()), 6) AS term
FROM lineitem GROUP BY 1""")
def entropy_breakdown(spark, d):
    x = en.class_distribution(t(spark, d, "lineitem"), LI_TARGET)
    return x.select(LI_TARGET, "n", r6("p").alias("p"), r6("term").alias("term"))


# ---------------------------------------------------------------- EN1 EN3 EN4
@register("entropy_summary", "EN1 EN3 EN4", sql="""
WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT n, n / sum(n) OVER () AS p FROM c),
s AS (SELECT -sum(p * log2(p)) AS h, count(*) AS k, sum(n) AS n, sum(p) AS ps FROM p)
SELECT round_even(h, 6) AS entropy, k AS n_classes, CAST(n AS BIGINT) AS n_rows, round_even(ps, 6) AS prob_sum,
       round_even(CASE WHEN k > 1 THEN log2(k) ELSE 0 END, 6) AS max_entropy,
       round_even(CASE WHEN k > 1 THEN h / log2(k) END, 6) AS normalised_entropy,
       CASE WHEN h = 0 THEN 'Pure' WHEN h / log2(k) < 0.3 THEN 'Relatively Pure'
            WHEN h / log2(k) < 0.7 THEN 'Moderately Impure' ELSE 'Highly Impure' END AS purity,
       CASE WHEN h = 0 THEN 'pure' WHEN h < 0.5 THEN 'relatively pure'
            WHEN h < 0.9 THEN 'moderate impurity' ELSE 'high impurity' END AS purity_absolute FROM s""")
def entropy_summary(spark, d):
    s = en.entropy_summary(t(spark, d, "orders"), "o_orderstatus")
    return s.select(r6("entropy").alias("entropy"), "n_classes", "n_rows", r6("prob_sum").alias("prob_sum"),
                    r6("max_entropy").alias("max_entropy"), r6("normalised_entropy").alias("normalised_entropy"),
                    "purity", "purity_absolute")


# ---------------------------------------------------------------- EN5
_EN5 = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@register("feature_entropy", "EN5", sql=f"""
WITH l AS ({unpivot_sql('SELECT * FROM lineitem', _EN5, [], 'feature', 'value')}),
c AS (SELECT feature, value, count(*) AS c FROM l WHERE value IS NOT NULL GROUP BY ALL),
e AS (SELECT feature, count(*) AS n_values, -sum(c / n * log2(c / n)) AS h
      FROM (SELECT *, sum(c) OVER (PARTITION BY feature) AS n FROM c) GROUP BY feature)
SELECT feature, n_values, round_even(h, 6) AS entropy,
       CAST(row_number() OVER (ORDER BY h DESC, feature) AS INTEGER) AS rank FROM e""")
def feature_entropy(spark, d):
    e = en.feature_entropies(t(spark, d, "lineitem"), _EN5)
    return e.select("feature", "n_values", r6("entropy").alias("entropy"), "rank")


# ---------------------------------------------------------------- EN6
_ROW_SQL = ("SELECT *, CASE WHEN len(a) = 0 THEN 0.0 ELSE "
            "list_reduce(list_transform(a, lambda x: -(x / list_reduce(a, lambda u, v: u + v, 0.0)) * "
            "log2(x / list_reduce(a, lambda u, v: u + v, 0.0))), lambda u, v: u + v, 0.0) END AS row_entropy "
            "FROM (SELECT *, list_filter([l_quantity, l_extendedprice, l_discount, l_tax], lambda x: x > 0) AS a "
            "FROM lineitem)")


def _row_entropy_frame(spark, d):
    li = t(spark, d, "lineitem")
    return li.withColumn("row_entropy", en.row_entropy(LI_NUMERIC))


@register("row_entropy", "EN6 UD2", sql=(
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even(row_entropy, 6) AS row_entropy "
    f"FROM ({_ROW_SQL})"))
def row_entropy(spark, d):
    x = _row_entropy_frame(spark, d)
    return x.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r6("row_entropy").alias("row_entropy"))


@register("row_entropy_summary", "EN7 AG10 AG9", sql=f"""
SELECT count(*) AS n, round_even(avg(row_entropy), 6) AS mean, round_even(stddev_pop(row_entropy), 6) AS std_pop,
       round_even(min(row_entropy), 6) AS min, round_even(quantile_cont(row_entropy, 0.1), 6) AS p10,
       round_even(quantile_cont(row_entropy, 0.25), 6) AS p25,
       round_even(quantile_cont(row_entropy, 0.5), 6) AS median, round_even(quantile_cont(row_entropy, 0.75), 6) AS p75,
       round_even(quantile_cont(row_entropy, 0.9), 6) AS p90, round_even(quantile_cont(row_entropy, 0.95), 6) AS p95,
       round_even(quantile_cont(row_entropy, 0.99), 6) AS p99,
       round_even(max(row_entropy), 6) AS max, round_even(log2(4), 6) AS max_theoretical FROM ({_ROW_SQL})""")
def row_entropy_summary(spark, d):
    from cohortspark.operators.quantiles import exact_quantiles
    x = _row_entropy_frame(spark, d)
    q = exact_quantiles(x, ["row_entropy"], [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])["row_entropy"]
    s = x.agg(F.count(F.lit(1)).alias("n"), F.avg("row_entropy").alias("mean"),
              F.stddev_pop("row_entropy").alias("std_pop"), F.min("row_entropy").alias("min"),
              F.max("row_entropy").alias("max"))
    return s.select("n", r6("mean").alias("mean"), r6("std_pop").alias("std_pop"), r6("min").alias("min"),
                    *[r6(F.lit(v)).alias(k) for k, v in zip(["p10", "p25", "median", "p75", "p90", "p95", "p99"], q)],
                    r6("max").alias("max"), r6(F.log2(F.lit(4.0))).alias("max_theoretical"))


@register("row_entropy_by_class", "AG14", sql=f"""
SELECT l_returnflag, count(*) AS n, round_even(avg(row_entropy), 6) AS mean,
       round_even(quantile_cont(row_entropy, 0.5), 6) AS median, round_even(stddev_pop(row_entropy), 6) AS std_pop
FROM ({_ROW_SQL}) GROUP BY 1""")
def row_entropy_by_class(spark, d):
    from cohortspark.operators.profile import class_quantiles
    x = _row_entropy_frame(spark, d)
    med = class_quantiles(x, ["row_entropy"], LI_TARGET, [0.5]).select(F.col(LI_TARGET).alias("cls"), F.col("row_entropy")[0].alias("median"))
    s = x.groupBy(LI_TARGET).agg(F.count(F.lit(1)).alias("n"), F.avg("row_entropy").alias("mean"),
                                 F.stddev_pop("row_entropy").alias("std_pop"))
    return s.join(med, F.col(LI_TARGET).eqNullSafe(F.col("cls")), "left").select(
        LI_TARGET, "n", r6("mean").alias("mean"), r6("median").alias("median"), r6("std_pop").alias("std_pop"))


@register("row_entropy_extremes", "AG19", sql=f"""
WITH x AS ({_ROW_SQL}), m AS (SELECT quantile_cont(row_entropy, 0.5) AS med FROM x)
SELECT 'min' AS which, arg_min(l_orderkey, (row_entropy, l_orderkey, l_partkey, l_suppkey, l_linenumber)) AS l_orderkey,
       round_even(min(row_entropy), 6) AS row_entropy FROM x
UNION ALL SELECT 'max', arg_max(l_orderkey, (row_entropy, -l_orderkey, -l_partkey, -l_suppkey, -l_linenumber)),
       round_even(max(row_entropy), 6) FROM x
UNION ALL SELECT 'nearest_median', arg_min(l_orderkey, (abs(row_entropy - med), l_orderkey, l_partkey, l_suppkey, l_linenumber)),
       round_even(arg_min(row_entropy, (abs(row_entropy - med), l_orderkey, l_partkey, l_suppkey, l_linenumber)), 6) FROM x, m""")
def row_entropy_extremes(spark, d):
    from cohortspark.operators.quantiles import exact_quantiles
    x = _row_entropy_frame(spark, d)
    med = exact_quantiles(x, ["row_entropy"], [0.5])["row_entropy"][0]
    key = [F.col(k) for k in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]]
    neg = [-c for c in key]
    s = x.agg(
        F.min_by("l_orderkey", F.struct(F.col("row_entropy"), *key)).alias("k_min"),
        F.min("row_entropy").alias("v_min"),
        F.max_by("l_orderkey", F.struct(F.col("row_entropy"), *neg)).alias("k_max"),
        F.max("row_entropy").alias("v_max"),
        F.min_by("l_orderkey", F.struct(F.abs(F.col("row_entropy") - F.lit(med)), *key)).alias("k_med"),
        F.min_by("row_entropy", F.struct(F.abs(F.col("row_entropy") - F.lit(med)), *key)).alias("v_med"))
    return s.select(F.explode(F.array(
        F.struct(F.lit("min").alias("which"), F.col("k_min").alias("l_orderkey"), r6("v_min").alias("row_entropy")),
        F.struct(F.lit("max").alias("which"), F.col("k_max").alias("l_orderkey"), r6("v_max").alias("row_entropy")),
        F.struct(F.lit("nearest_median").alias("which"), F.col("k_med").alias("l_orderkey"),
                 r6("v_med").alias("row_entropy")))).alias("s")).select("s.*")


# ---------------------------------------------------------------- EN12 / S4 (NULL policies)
_GAPS_SRC = ("SELECT CASE WHEN l_tax <> 0.0 THEN l_quantity END AS l_quantity, "
             "CASE WHEN l_discount <> 0.1 THEN l_extendedprice END AS l_extendedprice, "
             "l_discount, l_tax, l_linestatus, l_returnflag FROM lineitem")
_GAPS_LONG = unpivot_sql(qcut_bins_sql(_GAPS_SRC, LI_NUMERIC, 5, [LI_TARGET] + LI_CATEGORICAL), _FEATS, [LI_TARGET])


def _ig_gaps(policy):
    def build(spark, d):
        from cohortspark.plans.common import lineitem_with_gaps
        return _ig_out(en.information_gain(lineitem_with_gaps(spark, d), LI_TARGET, LI_NUMERIC,
                                           LI_CATEGORICAL, null_policy=policy))
    return build


register("ig_nulls_drop", "EN11 S4", sql=ig_sql(_GAPS_LONG, LI_TARGET, _TYPES, "drop"))(_ig_gaps("drop"))
register("ig_nulls_reference", "EN11 S4", sql=ig_sql(_GAPS_LONG, LI_TARGET, _TYPES, "reference"))(_ig_gaps("reference"))
register("ig_drop_null", "EN12", sql=ig_sql(_GAPS_LONG, LI_TARGET, _TYPES, "target_all"))(_ig_gaps("target_all"))


# ---------------------------------------------------------------- EN9
@register("ig_equal_width", "EN9", sql=ig_sql(
    unpivot_sql(__import__("cohortspark.plans.sqlgen", fromlist=["x"]).width_bins_sql(
        _LI_SRC, LI_NUMERIC, 5, [LI_TARGET] + LI_CATEGORICAL), _FEATS, [LI_TARGET]), LI_TARGET, _TYPES))
def ig_equal_width(spark, d):
    li = t(spark, d, "lineitem")
    return _ig_out(en.information_gain(li, LI_TARGET, LI_NUMERIC, LI_CATEGORICAL, binning="equal_width"))


# ---------------------------------------------------------------- EN10
def _auto_sql():
    raw = ", ".join(f"{c} AS raw_{c}" for c in LI_NUMERIC)
    src = f"SELECT {raw}, {', '.join(_FEATS)}, {LI_TARGET} FROM lineitem"
    q = qcut_bins_sql(src, LI_NUMERIC, 10, [LI_TARGET] + LI_CATEGORICAL + [f"raw_{c}" for c in LI_NUMERIC])
    pick = ", ".join(
        f"CASE WHEN (SELECT count(DISTINCT {c}) FROM lineitem) > 10 THEN CAST({c} AS VARCHAR) "
        f"ELSE CAST(raw_{c} AS VARCHAR) END AS {c}" for c in LI_NUMERIC)
    picked = f"SELECT {LI_TARGET}, {', '.join(LI_CATEGORICAL)}, {pick} FROM ({q})"
    return ig_sql(unpivot_sql(picked, _FEATS, [LI_TARGET]), LI_TARGET, _TYPES)


@register("ig_auto_bins", "EN10", sql=_auto_sql())
def ig_auto_bins(spark, d):
    li = t(spark, d, "lineitem")
    return _ig_out(en.information_gain(li, LI_TARGET, LI_NUMERIC, LI_CATEGORICAL, binning="auto", bins=10))


# ---------------------------------------------------------------- EN15-18
@register("ig_tiers", "EN15 EN16 EN17 EN18", sql=f"""
WITH g AS ({ig_sql(unpivot_sql(qcut_bins_sql(_LI_SRC, LI_NUMERIC, 5, [LI_TARGET] + LI_CATEGORICAL), _FEATS, [LI_TARGET]),
                   LI_TARGET, _TYPES, digits=12)}),
b AS (SELECT -sum(p * log2(p)) AS h FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY l_returnflag))
SELECT feature, CASE WHEN information_gain > 0.1 THEN 'high' WHEN information_gain > 0.01 THEN 'moderate' ELSE 'low' END AS tier,
       round_even(h - information_gain, 6) AS remaining_entropy, rank <= 3 AS in_top_n,
       CAST(row_number() OVER (PARTITION BY feature_type ORDER BY information_gain DESC, feature) AS INTEGER) AS type_rank,
       information_gain > avg(information_gain) OVER () AS above_mean, pct_base_entropy > 1.0 AS above_one_pct
FROM g, b""")
def ig_tiers(spark, d):
    li = t(spark, d, "lineitem")
    r = en.gain_report(en.information_gain(li, LI_TARGET, LI_NUMERIC, LI_CATEGORICAL), top_n=3)
    return r.select("feature", "tier", r6("remaining_entropy").alias("remaining_entropy"), "in_top_n",
                    "type_rank", "above_mean", "above_one_pct")
