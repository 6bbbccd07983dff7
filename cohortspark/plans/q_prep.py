"""Split / fold / bootstrap and feature-engineering queries (SP*, FE*, PR*, FN1-2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortspark.functions import columns as fx
from cohortspark.operators import features as fe
from cohortspark.operators import split as sp
from cohortspark.plans.common import LI_KEY, LI_NUMERIC, LI_TARGET, lineitem_with_gaps, r6, t
from cohortspark.operators.profile import feature_report
from cohortspark.plans.registry import register
from cohortspark.session import checkpoint_dir
from cohortspark.sources import has_flag, load_source, write_flagged, write_table

H_ORD = sp.hash60_sql(["o_orderkey"])
H_LI = sp.hash60_sql(LI_KEY)
C70 = sp.cut_points([0.7, 0.3])[0]
C60, C80 = sp.cut_points([0.6, 0.2, 0.2])


def _split_sql(h, cuts, names):
    parts = " ".join(f"WHEN {h} < {c} THEN '{n}'" for n, c in zip(names[:-1], cuts))
    return f"CASE {parts} ELSE '{names[-1]}' END"


# ---------------------------------------------------------------- SP1 / SP2 / SP3
@register("stratified_split", "SP1 S13", sql=(
    f"SELECT o_orderkey, o_orderstatus, {_split_sql(H_ORD, [C70], ['train', 'test'])} AS split FROM orders"))
def stratified_split(spark, d):
    o = sp.assign_split(t(spark, d, "orders"), ["o_orderkey"])
    return o.select("o_orderkey", "o_orderstatus", "split")


@register("split_three_way", "SP2 PR9", sql=(
    f"SELECT o_orderkey, {_split_sql(H_ORD, [C60, C80], ['train', 'val', 'test'])} AS split, "
    "o_totalprice > 300000 AS has_outlier FROM orders"))
def split_three_way(spark, d):
    o = sp.assign_split(t(spark, d, "orders"), ["o_orderkey"], ("train", "val", "test"), (0.6, 0.2, 0.2))
    return o.select("o_orderkey", "split", (F.col("o_totalprice") > 300000).alias("has_outlier"))


@register("split_report", "SP3", sql=f"""
WITH s AS (SELECT {_split_sql(H_ORD, [C60, C80], ['train', 'val', 'test'])} AS split, o_orderstatus FROM orders),
c AS (SELECT split, o_orderstatus, count(*) AS n FROM s GROUP BY ALL)
SELECT split, o_orderstatus, n, round_even(n * 100.0 / sum(n) OVER (PARTITION BY split), 6) AS pct_of_split,
       CAST(sum(n) OVER (PARTITION BY split) AS BIGINT) AS split_rows FROM c""")
def split_report(spark, d):
    o = sp.assign_split(t(spark, d, "orders"), ["o_orderkey"], ("train", "val", "test"), (0.6, 0.2, 0.2))
    r = sp.split_report(o, "split", "o_orderstatus")
    return r.select("split", "o_orderstatus", "n", r6("pct_of_split").alias("pct_of_split"), "split_rows")


# ---------------------------------------------------------------- SP4 / SP5
_STEP5 = -(-sp.HASH_SPACE // 5)


@register("kfold", "SP4", sql=(
    f"SELECT o_orderkey, o_orderstatus, CAST(least({sp.hash60_sql(['o_orderkey'], salt='fold')} // {_STEP5}, 4) AS INTEGER) AS fold "
    "FROM orders"))
def kfold(spark, d):
    o = sp.assign_folds(t(spark, d, "orders"), ["o_orderkey"], k=5)
    return o.select("o_orderkey", "o_orderstatus", "fold")


@register("logo_folds", "SP5 S24", sql="""
SELECT CAST(year(o_orderdate) AS INTEGER) AS grp, CAST(dense_rank() OVER (ORDER BY year(o_orderdate)) - 1 AS INTEGER) AS fold,
       count(*) OVER (PARTITION BY year(o_orderdate)) AS n_rows, o_orderkey FROM orders""")
def logo_folds(spark, d):
    o = t(spark, d, "orders").withColumn("grp", F.year("o_orderdate"))
    f, _ = sp.group_folds(o, "grp")
    n = f.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows"))
    n = n.withColumnRenamed("grp", "of")
    return f.join(n, F.col("grp").eqNullSafe(F.col("of"))).select("grp", "fold", "n_rows", "o_orderkey")


# ---------------------------------------------------------------- SP6
_RULE_PRED = "CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END"


def _rule_pred():
    return F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.07, "N").otherwise("R")


def _boot_sql(reps=100):
    base = f"({sp.hash60_sql(LI_KEY, salt='boot')} % {sp.MIX_P})"
    x0 = f"(({base} + r * {sp.MIX_G}) % {sp.MIX_P})"
    m1 = f"(({x0} * {x0} + {sp.MIX_C1}) % {sp.MIX_P})"
    m2 = f"(({m1} * {sp.MIX_A} + {sp.MIX_C2}) % {sp.MIX_P})"
    u = f"(({m2} * {m2} + {sp.MIX_C1}) % {sp.MIX_P})"
    w = " + ".join(f"(u >= {c})::INTEGER" for c in sp.POISSON_CUTS_P)
    return f"""
WITH test AS (SELECT *, {_RULE_PRED} AS pred FROM lineitem WHERE {_split_sql(H_LI, [C70], ['train', 'test'])} = 'test'),
x AS (SELECT r, l_returnflag = pred AS ok, {u} AS u FROM test, range(1, {reps + 1}) g(r)),
reps AS (SELECT r, sum(({w}) * ok::INTEGER) / sum({w}) AS acc FROM x GROUP BY r)
SELECT round_even(avg(acc), 6) AS mean, round_even(stddev_pop(acc), 6) AS std,
       round_even(quantile_cont(acc, 0.025), 6) AS ci_low, round_even(quantile_cont(acc, 0.975), 6) AS ci_high,
       count(*) AS replicates FROM reps"""


@register("bootstrap_ci", "SP6 S14", sql=_boot_sql())
def bootstrap_ci(spark, d):
    li = sp.assign_split(t(spark, d, "lineitem"), LI_KEY).where(F.col("split") == "test")
    li = li.withColumn("pred", _rule_pred())
    s = sp.bootstrap_summary(sp.bootstrap_accuracy(li, LI_KEY, LI_TARGET, "pred", 100))
    return s.select(*[r6(c).alias(c) for c in ["mean", "std", "ci_low", "ci_high"]], "replicates")


def _boot_binary_sql(reps=50):
    m1 = f"((md5v + r * {sp.MIX_G}) % {sp.MIX_P})"
    b = f"({sp.hash60_sql(LI_KEY, salt='boot')} % {sp.MIX_P})"
    w = " + ".join(f"(u >= {c})::INTEGER" for c in sp.POISSON_CUTS_P)
    return f"""
WITH test AS (SELECT *, (l_returnflag = 'R')::INTEGER AS y, (l_quantity >= 25)::INTEGER AS p, {b} AS md5v FROM lineitem
              WHERE {_split_sql(H_LI, [C70], ['train', 'test'])} = 'test'),
x0 AS (SELECT r, y, p, l_quantity AS s, {m1} AS x FROM test, range(1, {reps + 1}) g(r)),
x1 AS (SELECT r, y, p, s, (x * x + {sp.MIX_C1}) % {sp.MIX_P} AS x FROM x0),
x2 AS (SELECT r, y, p, s, (x * {sp.MIX_A} + {sp.MIX_C2}) % {sp.MIX_P} AS x FROM x1),
x3 AS (SELECT r, y, p, s, (x * x + {sp.MIX_C1}) % {sp.MIX_P} AS u FROM x2),
x AS (SELECT r, y, p, s, {w} AS w FROM x3),
m AS (SELECT r, sum(w) FILTER (WHERE y = p) / sum(w) AS accuracy,
             2 * sum(w) FILTER (WHERE y = 1 AND p = 1) / (sum(w) FILTER (WHERE y = 1) + sum(w) FILTER (WHERE p = 1)) AS f1 FROM x GROUP BY r),
c AS (SELECT r, s, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM x GROUP BY r, s),
k AS (SELECT *, sum(neg) OVER (PARTITION BY r ORDER BY s) AS upto FROM c),
a AS (SELECT r, sum(pos * (upto - neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM k GROUP BY r),
l AS (SELECT 'accuracy' AS metric, accuracy AS v FROM m UNION ALL SELECT 'f1', f1 FROM m UNION ALL SELECT 'auc', auc FROM a)
SELECT metric, round_even(avg(v), 6) AS mean, round_even(stddev_pop(v), 6) AS std, round_even(quantile_cont(v, 0.025), 6) AS ci_low,
       round_even(quantile_cont(v, 0.975), 6) AS ci_high, count(*) AS replicates FROM l GROUP BY metric"""


@register("bootstrap_binary", "SP6 S14 ME8", sql=_boot_binary_sql())
def bootstrap_binary(spark, d):
    li = sp.assign_split(t(spark, d, "lineitem"), LI_KEY).where(F.col("split") == "test")
    li = li.withColumns({"y": (F.col(LI_TARGET) == "R").cast("int"), "p": (F.col("l_quantity") >= 25).cast("int")})
    reps = sp.bootstrap_binary(li, LI_KEY, "y", "p", "l_quantity", 50)
    long = reps.unpivot(["replicate"], ["accuracy", "f1", "auc"], "metric", "v")
    s = long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", 0.025).alias("ci_low"),
                                   F.percentile("v", 0.975).alias("ci_high"), F.count(F.lit(1)).alias("replicates"))
    return s.select("metric", *[r6(c).alias(c) for c in ["mean", "std", "ci_low", "ci_high"]], "replicates")


# ---------------------------------------------------------------- cohort-shaped frame
# Clinical roles mapped onto lineitem columns (an arithmetic re-scaling, all rows kept).
COHORT_SQL = ("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, "
              "l_quantity + 50 AS waist_circumference, l_extendedprice / 100 AS triglycerides, "
              "l_discount * 100 AS hdl, l_tax * 1000 AS ldl, l_tax * 1000 + l_discount * 100 + 50 AS total_cholesterol, "
              "15 + l_quantity * 0.5 AS bmi, 40 + l_linenumber * 3 AS age FROM lineitem")


def cohort(spark, d):
    li = t(spark, d, "lineitem")
    return li.select(*LI_KEY, LI_TARGET,
                     (F.col("l_quantity") + 50).alias("waist_circumference"),
                     (F.col("l_extendedprice") / 100).alias("triglycerides"),
                     (F.col("l_discount") * 100).alias("hdl"),
                     (F.col("l_tax") * 1000).alias("ldl"),
                     (F.col("l_tax") * 1000 + F.col("l_discount") * 100 + 50).alias("total_cholesterol"),
                     (15 + F.col("l_quantity") * 0.5).alias("bmi"),
                     (40 + F.col("l_linenumber") * 3).alias("age"))


_KEYS = ", ".join(LI_KEY)


@register("clinical_proxies", "FE1 FN4 FN5 S9", sql=f"""
SELECT {_KEYS}, round_even((waist_circumference - 58) * triglycerides, 6) AS lap,
       round_even(CASE WHEN hdl <> 0 AND triglycerides / hdl > 0 THEN log10(triglycerides / hdl) END, 6) AS log_tg_hdl,
       round_even(CASE WHEN hdl <> 0 THEN ldl / hdl END, 6) AS ldl_hdl_ratio,
       round_even(bmi * waist_circumference, 6) AS adiposity_index FROM ({COHORT_SQL})""")
def clinical_proxies(spark, d):
    x = fe.clinical_proxies(cohort(spark, d))
    return x.select(*LI_KEY, *[r6(c).alias(c) for c in ["lap", "log_tg_hdl", "ldl_hdl_ratio", "adiposity_index"]])


def _eng_sql():
    e = "1e-8"
    w, tg, h, l, tc, b, a = "waist_circumference", "triglycerides", "hdl", "ldl", "total_cholesterol", "bmi", "age"
    metab = f"({w} * {tg} / ({h} + {e}))"
    vai = f"(({w} / (36.58 + 1.89 * {b})) * ({tg} / 0.81) * (1.52 / ({h} + {e})))"
    lap = f"((CASE WHEN {w} - 58 < 0.01 THEN 0.01 ELSE {w} - 58 END) * {tg})"
    risk = [f"({b} >= 30)::INTEGER", f"({w} >= 88)::INTEGER", f"({tg} >= 150)::INTEGER", f"({h} < 50)::INTEGER"]
    cols = {
        "metabolic_proxy": metab, "ldl_hdl_ratio": f"{l} / ({h} + {e})", "tc_hdl_ratio": f"{tc} / ({h} + {e})",
        "trig_hdl_ratio": f"{tg} / ({h} + {e})", "bmi_age": f"{b} * {a}", "log_trig": f"ln(1 + {tg})",
        "log_bmi": f"ln(1 + {b})", "vai": vai, "lap": lap,
        "tyg_proxy": f"ln(CASE WHEN {tg} < 1 THEN 1 ELSE {tg} END) * ln(CASE WHEN {b} < 1 THEN 1 ELSE {b} END)",
        "bmi_obese": risk[0], "wc_risk": risk[1], "tg_risk": risk[2], "hdl_risk": risk[3],
        "met_syndrome_count": f"{risk[1]} + {risk[2]} + {risk[3]} + {risk[0]}",
        "waist_age": f"{w} * {a}", "bmi_trig": f"{b} * {tg}", "waist_sq": f"{w} * {w}", "bmi_sq": f"{b} * {b}",
        "waist_bmi_ratio": f"{w} / ({b} + {e})", "wc_hdl": f"{w} / ({h} + {e})", "bmi_hdl": f"{b} / ({h} + {e})",
        "log_lap": f"ln(1 + {lap})", "log_metabolic": f"ln(1 + CASE WHEN {metab} < 0 THEN 0 ELSE {metab} END)",
        "log_vai": f"ln(1 + CASE WHEN {vai} < 0 THEN 0 ELSE {vai} END)", "wc_trig": f"{w} * {tg}",
        "bmi_wc_hdl": f"{b} * {w} / ({h} + {e})",
    }
    ints = {"bmi_obese", "wc_risk", "tg_risk", "hdl_risk", "met_syndrome_count"}
    sel = ", ".join(f"{v} AS {k}" if k in ints else f"round_even({v}, 6) AS {k}" for k, v in cols.items())
    return f"SELECT {_KEYS}, {sel} FROM ({COHORT_SQL})"


@register("engineered_features", "FE2 FE3 FE4 FE5 FE6 FE7 FE8 FE9 PR14 UD5 JN2", sql=_eng_sql())
def engineered_features(spark, d):
    x = cohort(spark, d).transform(fe.engineer_features)
    ints = {"bmi_obese", "wc_risk", "tg_risk", "hdl_risk", "met_syndrome_count"}
    return x.select(*LI_KEY, *[F.col(c) if c in ints else r6(c).alias(c) for c in fe.ENGINEERED])


_INTER = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("interactions", "FE10 JN2", sql="SELECT " + _KEYS + ", " + ", ".join(
    f"round_even({' * '.join(k)}, 6) AS \"{'*'.join(k)}\"" for k in fe.interaction_names(_INTER, 3)) + " FROM lineitem")
def interactions(spark, d):
    terms = fe.interaction_terms(_INTER, 3)
    return t(spark, d, "lineitem").select(*LI_KEY, *[r6(v).alias(k) for k, v in terms.items()])


@register("standard_scale", "FE12 S6", sql=f"""
WITH s AS (SELECT *, {_split_sql(H_LI, [C70], ['train', 'test'])} AS split FROM lineitem),
p AS (SELECT {', '.join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LI_NUMERIC)} FROM s WHERE split = 'train')
SELECT {_KEYS}, split, {', '.join(f"round_even(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in LI_NUMERIC)} FROM s, p""")
def standard_scale(spark, d):
    li = sp.assign_split(t(spark, d, "lineitem"), LI_KEY)
    params = fe.fit_standard(li.where(F.col("split") == "train"), LI_NUMERIC)
    x = fe.apply_standard(li, params)
    return x.select(*LI_KEY, "split", *[r6(c).alias(c) for c in LI_NUMERIC])


@register("min_max_scale", "FE13 S7", sql=f"""
WITH p AS (SELECT {', '.join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in LI_NUMERIC)} FROM lineitem)
SELECT {_KEYS}, {', '.join(f"round_even(CASE WHEN hi_{c} = lo_{c} THEN 0 ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END, 6) AS {c}" for c in LI_NUMERIC)}
FROM lineitem, p""")
def min_max_scale(spark, d):
    li = t(spark, d, "lineitem")
    x = fe.apply_minmax(li, fe.fit_minmax(li, LI_NUMERIC))
    return x.select(*LI_KEY, *[r6(c).alias(c) for c in LI_NUMERIC])


@register("scaled_group_medians", "FE14 AG12", sql="""
WITH p AS (SELECT min(l_quantity) AS lq, max(l_quantity) AS hq, min(l_extendedprice) AS le, max(l_extendedprice) AS he FROM lineitem),
m AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_extendedprice, 0.5) AS e FROM lineitem GROUP BY 1)
SELECT l_returnflag, round_even((q - lq) / (hq - lq), 6) AS l_quantity, round_even((e - le) / (he - le), 6) AS l_extendedprice FROM m, p""")
def scaled_group_medians(spark, d):
    from cohortspark.operators.profile import class_quantiles
    li = t(spark, d, "lineitem")
    cols = ["l_quantity", "l_extendedprice"]
    params = fe.fit_minmax(li, cols)
    m = class_quantiles(li, cols, LI_TARGET, [0.5]).select(LI_TARGET, *[F.col(c)[0].alias(c) for c in cols])
    return fe.apply_minmax(m, params).select(LI_TARGET, *[r6(c).alias(c) for c in cols])


# TPC-H order priority and status domains, for the oracle's
# static dummy list (Spark learns the levels from the training split).
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_STATUSES = ["F", "O", "P"]
_ONE_HOT_SQL = "SELECT o_orderkey, " + ", ".join(
    [f"(o_orderpriority = '{v}')::INTEGER AS \"o_orderpriority_{v}\"" for v in _PRIORITIES[1:]]
    + [f"(o_orderstatus = '{v}')::INTEGER AS \"o_orderstatus_{v}\"" for v in _STATUSES[1:]]) + " FROM orders"


@register("one_hot", "FE15 S11", sql=_ONE_HOT_SQL)
def one_hot(spark, d):
    """Levels are learned from the training split (sorted; first dropped)."""
    o = sp.assign_split(t(spark, d, "orders"), ["o_orderkey"])
    levels = fe.fit_levels(o.where(F.col("split") == "train"), ["o_orderpriority", "o_orderstatus"])
    x = fe.apply_one_hot(o, levels)
    dummies = [c for c in x.columns if c.startswith("o_orderpriority_") or c.startswith("o_orderstatus_")]
    return x.select("o_orderkey", *dummies)


# Fixed values for the ordinal-encoding demo: a priority map with one level
# left out on purpose, so unmapped values become NULL (S21).
PRIORITY_MAP = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3}


@register("ordinal_encode", "PR6 JN1 S21", sql=(
    "SELECT o_orderkey, CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY_MAP.items())
    + " END AS priority_code FROM orders"))
def ordinal_encode(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", fx.ordinal_encode("o_orderpriority", PRIORITY_MAP).alias("priority_code"))


@register("period_split", "FN1 FN2 PR8", sql="""
SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(year(o_orderdate) + 1 AS VARCHAR) AS period,
       CAST(year(o_orderdate) AS INTEGER) AS period_start, CAST(year(o_orderdate) + 1 AS INTEGER) AS period_end FROM orders""")
def period_split(spark, d):
    o = t(spark, d, "orders")
    p = F.concat_ws("-", F.year("o_orderdate").cast("string"), (F.year("o_orderdate") + 1).cast("string"))
    x = o.select("o_orderkey", p.alias("period"))
    return x.select("o_orderkey", "period", fx.period_start("period").alias("period_start"),
                    fx.period_end("period").alias("period_end"))


@register("round_half_even", "PR15 S5", sql=(
    f"SELECT {_KEYS}, round_even(l_extendedprice * 0.125, 2) AS rounded FROM lineitem"))
def round_half_even(spark, d):
    li = t(spark, d, "lineitem")
    return li.select(*LI_KEY, fx.round_half_even(F.col("l_extendedprice") * 0.125, 2).alias("rounded"))


@register("dropna_subset", "PR11 PR9", sql=f"""
SELECT (SELECT count(*) FROM lineitem) AS n_before,
       (SELECT count(*) FROM (SELECT CASE WHEN l_tax <> 0.0 THEN l_quantity END AS q,
               CASE WHEN l_discount <> 0.1 THEN l_extendedprice END AS e FROM lineitem) WHERE q IS NOT NULL AND e IS NOT NULL) AS n_after""")
def dropna_subset(spark, d):
    g = lineitem_with_gaps(spark, d)
    # dropna(subset) keeps exactly the rows where every subset column is present
    return g.agg(F.count(F.lit(1)).alias("n_before"),
        F.count_if(fx.all_present(["l_quantity", "l_extendedprice"])).alias("n_after"))


def _flag_path(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_GAP_COLS = ["l_quantity", "l_extendedprice"]
_GAP_SQL = (f"SELECT {', '.join(LI_KEY)}, CASE WHEN l_tax <> 0.0 THEN l_quantity END AS l_quantity, "
            "CASE WHEN l_discount <> 0.1 THEN l_extendedprice END AS l_extendedprice FROM lineitem")


@register("dropna_rows", "PR11 PR9 SC4", sql=f"""
WITH g AS ({_GAP_SQL}), k AS (SELECT * FROM g WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)
SELECT {', '.join(LI_KEY)}, l_quantity, l_extendedprice, (SELECT count(*) FROM g) AS n_before, (SELECT count(*) FROM k) AS n_after FROM k""")
def dropna_rows(spark, d):
    """Rows with a gap are dropped; the counts before and after come from the mask that the write left."""
    g = lineitem_with_gaps(spark, d).select(*LI_KEY, *_GAP_COLS)
    flags = {c: F.col(c).isNull() for c in _GAP_COLS} | {"any": ~fx.all_present(_GAP_COLS)}
    rows, counts = write_flagged(g, flags, _flag_path(spark, "dropna"))
    c = counts.where("flag = 'any'").first()
    return rows.where(~has_flag(flags, "any")).select(*LI_KEY, *_GAP_COLS, F.lit(c["n_rows"]).alias("n_before"),
                                                      F.lit(c["n_rows"] - c["n"]).alias("n_after"))


_CLIP = {"l_quantity": (5.0, 45.0), "l_extendedprice": (2000.0, 60000.0)}


@register("clip_issues", "OU2 FN6 PR16 SC4", sql=" UNION ALL ".join(
    f"SELECT '{c} {side}' AS issue, count_if({c} {op} {v}) AS n, count(*) AS n_rows, round_even(sum(CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END), 2) "
    f"AS clipped_sum, count_if({c} {op} {v}) > 0.02 * count(*) AS flagged FROM lineitem"
    for c, (lo, hi) in _CLIP.items() for side, op, v in (("below", "<", lo), ("above", ">", hi))))
def clip_issues(spark, d):
    """Values are clipped into range and written; the rows below and above each range are counted from the written mask, and
    an issue is flagged where they are more than 2 %."""
    from cohortspark.operators.outliers import range_clip
    li = t(spark, d, "lineitem").select(*dict.fromkeys([*LI_KEY, *_CLIP]))
    flags = {f"{c} {side}": cond for c, (lo, hi) in _CLIP.items() for side, cond in (("below", F.col(c) < lo), ("above", F.col(c) > hi))}
    named = li.select("*", *[cond.alias(f"__f{i}") for i, cond in enumerate(flags.values())])
    clipped = range_clip(named, _CLIP)
    marks = {name: F.col(f"__f{i}") for i, name in enumerate(flags)}
    rows, counts = write_flagged(clipped, marks, _flag_path(spark, "clip"))
    sums = rows.agg(*[r6(F.sum(c), 2).alias(c) for c in _CLIP]).unpivot([], list(_CLIP), "c", "clipped_sum")
    return counts.join(sums, F.split("flag", " ")[0] == F.col("c")).select(
        F.col("flag").alias("issue"), "n", "n_rows", "clipped_sum", (F.col("n") > F.col("n_rows") * 0.02).alias("flagged"))


@register("feature_columns", "PR7 PR13 S12", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS kind, count({c}) AS n, count_if({c} IS NULL) AS n_missing, count(DISTINCT {c}) AS n_distinct FROM orders"
    for c, k in (("o_custkey", "numeric"), ("o_totalprice", "numeric"), ("o_orderstatus", "string"), ("o_orderpriority", "string"))))
def feature_columns(spark, d):
    """The numeric and string feature columns (all but key and target), with their present, missing and distinct values."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    numeric, strings = fe.feature_columns(o, ["o_orderkey"])
    return feature_report(o, numeric, strings)


@register("cohort_source", "SC2 PR1 PR4 SC1", sql=(
    "SELECT l_quantity, l_extendedprice, l_tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem"))
def cohort_source(spark, d):
    """The parameterised source on a CSV path, without the diagnostic column."""
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    src = t(spark, d, "lineitem").select(*feats, LI_TARGET)
    path = write_table(src, _flag_path(spark, "cohort") + "/cohort.csv", "csv")
    return load_source(spark, path, feats, LI_TARGET, "R", diagnostic=["l_discount"], schema=src.schema)


@register("numeric_columns", "PR7 PR13 S12", sql=(
    "SELECT column_name FROM (DESCRIBE SELECT * FROM lineitem) "
    "WHERE column_type IN ('INTEGER', 'BIGINT', 'DOUBLE', 'FLOAT', 'SMALLINT', 'TINYINT')"))
def numeric_columns(spark, d):
    from cohortspark.operators.profile import numeric_columns as nc
    li = t(spark, d, "lineitem")
    cols = nc(li)
    return spark.createDataFrame([(c,) for c in cols], "column_name string")


@register("binary_targets", "PR4 PR5 UD1", sql=(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_filled, "
    "(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 "
    "WHEN '4-NOT SPECIFIED' THEN 3 END >= 1)::INTEGER AS not_urgent FROM orders"))
def binary_targets(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", fx.binary_target("o_orderstatus", "F").alias("is_filled"),
                    fx.threshold_flag(fx.ordinal_encode("o_orderpriority", PRIORITY_MAP), 1).alias("not_urgent"))


@register("clamp_train_bounds", "OU4 S23 JN5", sql=f"""
WITH s AS (SELECT *, {_split_sql(H_LI, [C60, C80], ['train', 'val', 'test'])} AS split, l_quantity > 45 AS has_outlier FROM lineitem),
b AS (SELECT {', '.join(f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}" for c in ['l_extendedprice', 'l_quantity'])}
      FROM s WHERE split = 'train' AND NOT has_outlier)
SELECT {_KEYS}, split, has_outlier, {', '.join(f"round_even(CASE WHEN has_outlier THEN (CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END) ELSE {c} END, 6) AS {c}" for c in ['l_extendedprice', 'l_quantity'])}
FROM s, b""")
def clamp_train_bounds(spark, d):
    from cohortspark.operators.outliers import clamp_with_train_bounds
    li = sp.assign_split(t(spark, d, "lineitem"), LI_KEY, ("train", "val", "test"), (0.6, 0.2, 0.2))
    li = li.withColumn("has_outlier", F.col("l_quantity") > 45)
    x, _ = clamp_with_train_bounds(li, ["l_extendedprice", "l_quantity"], "has_outlier")
    return x.select(*LI_KEY, "split", "has_outlier", r6("l_extendedprice").alias("l_extendedprice"),
                    r6("l_quantity").alias("l_quantity"))


@register("stratified_split_exact", "SP1 SP2 S13", sql=f"""
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H_ORD}, o_orderkey) AS rk,
                  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN rk <= ceil(0.6 * n - 1e-9) THEN 'train'
       WHEN rk <= ceil((0.6 + 0.2) * n - 1e-9) THEN 'val' ELSE 'test' END AS split FROM r""")
def stratified_split_exact(spark, d):
    """Exact per-class counts (rank <= ceil(F * n_class)) without a window
    over a whole class; the oracle is the textbook row_number() form."""
    o = sp.exact_stratified_split(t(spark, d, "orders"), ["o_orderkey"], "o_orderstatus",
                                  ("train", "val", "test"), (0.6, 0.2, 0.2))
    return o.select("o_orderkey", "o_orderstatus", "split")


def _kfold_exact_sql(k=5):
    acc, cuts = 0.0, []
    for _ in range(k - 1):
        acc += 1.0 / k
        cuts.append(repr(acc))
    case = " ".join(f"WHEN rk <= ceil({c} * n - 1e-9) THEN {j}" for j, c in enumerate(cuts))
    return f"""
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H_ORD}, o_orderkey) AS rk,
                  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CAST(CASE {case} ELSE {k - 1} END AS INTEGER) AS fold FROM r"""


@register("kfold_exact", "SP4 S13", sql=_kfold_exact_sql())
def kfold_exact(spark, d):
    o = sp.exact_stratified_folds(t(spark, d, "orders"), ["o_orderkey"], "o_orderstatus", k=5)
    return o.select("o_orderkey", "o_orderstatus", "fold")
