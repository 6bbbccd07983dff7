"""Imputation and k-NN queries (IM1-IM5, ML9, JN3, JN4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import impute as im
from cohortspark.operators.knn import knn_vote
from cohortspark.operators.profile import missing_report
from cohortspark.operators import split as sp
from cohortspark.operators.vector_index import vector_knn
from cohortspark.plans.common import LI_KEY, lineitem_with_gaps, r6, t
from cohortspark.plans.registry import register
from cohortspark.session import stored

_KEYS = ", ".join(LI_KEY)
GAPS_SQL = ("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
            "CASE WHEN l_tax <> 0.0 THEN l_quantity END AS l_quantity, "
            "CASE WHEN l_discount <> 0.1 THEN l_extendedprice END AS l_extendedprice, "
            "l_discount, l_tax, l_returnflag FROM lineitem")


@register("median_fill", "IM1", sql=f"""
WITH g AS ({GAPS_SQL}), m AS (SELECT quantile_cont(l_quantity, 0.5) AS mq, quantile_cont(l_extendedprice, 0.5) AS me FROM g)
SELECT {_KEYS}, round_even(coalesce(l_quantity, mq), 6) AS l_quantity, round_even(coalesce(l_extendedprice, me), 6) AS l_extendedprice
FROM g, m""")
def median_fill(spark, d):
    x, _ = im.median_fill(lineitem_with_gaps(spark, d), ["l_quantity", "l_extendedprice"])
    return x.select(*LI_KEY, r6("l_quantity").alias("l_quantity"), r6("l_extendedprice").alias("l_extendedprice"))


@register("mode_fill", "IM2 AG18 S27", sql=f"""
WITH g AS ({GAPS_SQL}),
m AS (SELECT l_quantity AS mq FROM g WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, l_quantity LIMIT 1)
SELECT {_KEYS}, round_even(coalesce(l_quantity, mq), 6) AS l_quantity FROM g, m""")
def mode_fill(spark, d):
    x, _ = im.mode_fill(lineitem_with_gaps(spark, d), ["l_quantity"])
    return x.select(*LI_KEY, r6("l_quantity").alias("l_quantity"))


@register("missing_before_after", "IM5 AG4", sql=f"""
WITH g AS ({GAPS_SQL}),
m AS (SELECT quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_extendedprice, 0.5) AS e FROM g)
SELECT 'l_quantity' AS column_name, count_if(l_quantity IS NULL) AS missing_before, count_if(coalesce(l_quantity, q) IS NULL) AS missing_after FROM g, m
UNION ALL SELECT 'l_extendedprice', count_if(l_extendedprice IS NULL), count_if(coalesce(l_extendedprice, e) IS NULL) FROM g, m""")
def missing_before_after(spark, d):
    g = lineitem_with_gaps(spark, d)
    cols = ["l_quantity", "l_extendedprice"]
    filled, _ = im.median_fill(g, cols)
    b = missing_report(g, cols).select("column_name", F.col("n_missing").alias("missing_before"))
    a = missing_report(filled, cols).select("column_name", F.col("n_missing").alias("missing_after"))
    return b.join(a, "column_name")


# ---------------------------------------------------------------- supplier profile for KNN fill
_PROFILE_FEATS = ["s_acctbal", "avg_qty", "avg_price", "avg_disc", "n_lines"]
_PROFILE_SQL = """
SELECT s.s_suppkey, CASE WHEN s.s_nationkey NOT IN (1, 2) THEN s.s_acctbal END AS s_acctbal,
       CASE WHEN s.s_nationkey NOT IN (3, 4) THEN a.avg_qty END AS avg_qty, a.avg_price, a.avg_disc,
       CAST(a.n_lines AS DOUBLE) AS n_lines
FROM supplier s JOIN (SELECT l_suppkey, avg(l_quantity) AS avg_qty, avg(l_extendedprice) AS avg_price,
                             avg(l_discount) AS avg_disc, count(*) AS n_lines FROM lineitem GROUP BY 1) a
ON s.s_suppkey = a.l_suppkey"""


def supplier_profile(spark, d):
    li = t(spark, d, "lineitem")
    agg = li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.avg("l_quantity").alias("avg_qty"), F.avg("l_extendedprice").alias("avg_price"),
        F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).cast("double").alias("n_lines"))
    s = t(spark, d, "supplier")
    return s.join(agg, "s_suppkey").select(
        "s_suppkey", F.when(~F.col("s_nationkey").isin(1, 2), F.col("s_acctbal")).alias("s_acctbal"),
        F.when(~F.col("s_nationkey").isin(3, 4), F.col("avg_qty")).alias("avg_qty"), "avg_price", "avg_disc", "n_lines")


def _knn_fill_sql(targets, k=5):
    p = len(_PROFILE_FEATS)
    present = " + ".join(f"(q.{f} IS NOT NULL AND d.{f} IS NOT NULL)::INTEGER" for f in _PROFILE_FEATS)
    sumsq = " + ".join(f"CASE WHEN q.{f} IS NOT NULL AND d.{f} IS NOT NULL THEN (q.{f} - d.{f}) * (q.{f} - d.{f}) ELSE 0.0 END"
                       for f in _PROFILE_FEATS)
    ctes, sel = [f"p AS ({_PROFILE_SQL})"], []
    for c in targets:
        ctes.append(f"""pr_{c} AS (SELECT q.s_suppkey AS qk, d.s_suppkey AS dk, d.{c} AS dv,
    CASE WHEN {present} > 0 THEN sqrt({float(p)} / ({present}) * ({sumsq})) END AS dist
    FROM p q, p d WHERE q.{c} IS NULL AND d.{c} IS NOT NULL),
top_{c} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY dist, dk) AS rn FROM pr_{c} WHERE dist IS NOT NULL) WHERE rn <= {k}),
f_{c} AS (SELECT qk, sum(w * dv) / sum(w) AS v FROM (SELECT qk, dv, CASE WHEN max((dist = 0)::INTEGER) OVER (PARTITION BY qk) = 1
    THEN (dist = 0)::INTEGER::DOUBLE ELSE 1.0 / dist END AS w FROM top_{c}) GROUP BY qk)""")
        sel.append(f"round_even(coalesce(p.{c}, f_{c}.v, (SELECT avg({c}) FROM p)), 6) AS {c}")
    joins = " ".join(f"LEFT JOIN f_{c} ON f_{c}.qk = p.s_suppkey" for c in targets)
    return f"WITH {', '.join(ctes)} SELECT p.s_suppkey, {', '.join(sel)} FROM p {joins}"


@register("knn_fill", "IM4 S16 JN3 JN4", sql=_knn_fill_sql(["s_acctbal", "avg_qty"]))
def knn_fill(spark, d):
    prof = supplier_profile(spark, d)
    x = im.knn_fill(stored(prof, "supplier-profile"), ["s_suppkey"], _PROFILE_FEATS, k=5, targets=["s_acctbal", "avg_qty"], occupancy=16)
    return x.select("s_suppkey", r6("s_acctbal").alias("s_acctbal"), r6("avg_qty").alias("avg_qty"))


# ---------------------------------------------------------------- ML9 KNN classifier on embeddings
_H_VEC = sp.hash60_sql(["vec_id"])
_C70 = sp.cut_points([0.7, 0.3])[0]


@register("knn_classify", "ML9 JN4", sql=f"""
WITH e AS (SELECT vec_id, label, embedding, CASE WHEN {_H_VEC} < {_C70} THEN 'train' ELSE 'test' END AS split FROM embeddings),
pairs AS (SELECT q.vec_id AS qk, d.vec_id AS dk, d.label AS dl,
   sqrt(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))) AS dist
   FROM e q, e d WHERE q.split = 'test' AND d.split = 'train'),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY dist, dk) AS rn FROM pairs) WHERE rn <= 5),
v AS (SELECT qk, dl, count(*)::DOUBLE AS score FROM top GROUP BY ALL)
SELECT qk AS vec_id, dl AS prediction, score FROM (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY score DESC, dl) AS r FROM v) WHERE r = 1""")
def knn_classify(spark, d):
    """k-NN vote in 64 dimensions through the pivot index; every answer is exact."""
    e = sp.assign_split(t(spark, d, "embeddings"), ["vec_id"]).select("vec_id", "label", "embedding", "split")
    nn = vector_knn(e.where("split = 'test'"), e.where("split = 'train'"), ["vec_id"], ["vec_id"], "embedding", 5, payload=["label"])
    return knn_vote(nn, ["vec_id"], "d_label")


def _segment_tables(spark, d):
    """All customers, their segment missing for two nations, and as donor table the customers of the others."""
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"), F.avg("o_totalprice").alias("avg_total"))
    c = t(spark, d, "customer").join(o, "c_custkey", "left").select(
        "c_custkey", "c_nationkey", "c_acctbal", "n_orders", "avg_total", "c_mktsegment")
    gone = F.col("c_nationkey").isin(1, 2)
    return c.withColumn("c_mktsegment", F.when(~gone, F.col("c_mktsegment"))), c.where(~gone)


_SEG_FEATS = ["c_acctbal", "n_orders", "avg_total"]


@register("model_fill", "IM3 SC3 ML4")
def model_fill(spark, d):
    """Rows-only: random-forest fill of a missing customer segment, trained on the donor table."""
    target, donors = _segment_tables(spark, d)
    filled, _ = im.model_fill(target, donors, "c_mktsegment", _SEG_FEATS, num_trees=50, max_depth=8)
    return filled.select("c_custkey", "c_mktsegment")


@register("model_fill_report", "IM3 IM5 ML15")
def model_fill_report(spark, d):
    """Rows-only: 5-fold accuracy on the donors, importances and the distribution of the filled values."""
    target, donors = _segment_tables(spark, d)
    filled, _ = im.model_fill(target, donors, "c_mktsegment", _SEG_FEATS, num_trees=20, max_depth=6)
    r = im.fill_report(donors, filled, F.col("c_nationkey").isin(1, 2), "c_mktsegment", _SEG_FEATS, ["c_custkey"],
                       num_trees=10, max_depth=5)
    return r.select("part", "name", r6("value").alias("value"))
