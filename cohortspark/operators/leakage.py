"""Label-leakage audit (AG17, AG23-AG26, FN3, PR16).

All statistics are sufficient statistics from one aggregation per report;
the per-feature result rows (a handful) are the only thing computed further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.stats import t_pvalue_udf


def class_threshold_report(df: DataFrame, label: str, rules: dict[str, float]) -> DataFrame:
    """AG23: per (feature, class) mean / min / max and share of rows >= threshold."""
    long = df.select(F.col(label), *[F.col(f).cast("double").alias(f) for f in rules]).unpivot(
        [label], list(rules), "feature", "x")
    thr = F.create_map(*[v for f, t in rules.items() for v in (F.lit(f), F.lit(float(t)))])
    return long.groupBy("feature", label).agg(
        F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"),
        (F.count_if(F.col("x") >= thr[F.col("feature")]) / F.count(F.lit(1)) * 100).alias("pct_at_or_above"))


def rule_accuracy(df: DataFrame, label: str, rules: dict[str, float], alert: float = 0.95) -> DataFrame:
    """AG24: accuracy of the rule (x >= t) -> 1 against a 0/1 label; NULL x predicts 0."""
    aggs = [F.avg((F.coalesce((F.col(f) >= F.lit(t)).cast("int"), F.lit(0)) == F.col(label)).cast("double")).alias(f)
            for f, t in rules.items()]
    long = df.agg(*aggs).unpivot([], list(rules), "feature", "accuracy")
    thr = F.create_map(*[v for f, t in rules.items() for v in (F.lit(f), F.lit(float(t)))])
    return long.select("feature", thr[F.col("feature")].alias("threshold"), "accuracy",
                       (F.col("accuracy") >= alert).alias("alert"))


def range_overlap(df: DataFrame, label: str, feats: list[str], pos=1) -> DataFrame:
    """AG25: overlap of the class ranges and the % of all rows inside it
    (0 when the ranges do not overlap; a class without values has NULL bounds and no overlap). Two passes: class min/max, then counts."""
    aggs = []
    for i, f in enumerate(feats):
        x = F.col(f).cast("double")
        is_pos = F.col(label) == F.lit(pos)
        aggs += [F.min(F.when(is_pos, x)).alias(f"a{i}"), F.max(F.when(is_pos, x)).alias(f"b{i}"),
                 F.min(F.when(~is_pos, x)).alias(f"c{i}"), F.max(F.when(~is_pos, x)).alias(f"d{i}")]
    r = df.agg(*aggs).first()
    bounds = []
    for i, f in enumerate(feats):
        a, b, c, d = (r[f"{e}{i}"] for e in "abcd")
        lo, hi = (None, None) if a is None or c is None else (max(a, c), min(b, d))
        bounds.append((f, r[f"a{i}"], r[f"b{i}"], r[f"c{i}"], r[f"d{i}"], lo, hi))
    cnt = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col(f).cast("double").between(F.lit(lo).cast("double"), F.lit(hi).cast("double"))).alias(f"o{i}")
        for i, (f, *_, lo, hi) in enumerate(bounds)]).first()
    rows = [(f, a, b, c, d, lo, hi, (cnt[f"o{i}"] / cnt["n"] * 100.0) if lo is not None and hi > lo else 0.0)
            for i, (f, a, b, c, d, lo, hi) in enumerate(bounds)]
    return df.sparkSession.createDataFrame(
        rows, "feature string, pos_min double, pos_max double, neg_min double, neg_max double, "
              "overlap_lo double, overlap_hi double, overlap_pct double")


def t_statistics(df: DataFrame, label: str, feats: list[str], pos=1, with_p: bool = False) -> DataFrame:
    """AG26 / S17: pooled-variance two-sample t (positive minus negative class),
    degrees of freedom, and optionally the two-sided p-value."""
    long = df.select(F.col(label), *[F.col(f).cast("double").alias(f) for f in feats]).unpivot(
        [label], feats, "feature", "x").where(F.col("x").isNotNull())
    is_pos = F.col(label) == F.lit(pos)
    s = long.groupBy("feature").agg(
        F.count_if(is_pos).alias("n1"), F.count_if(~is_pos).alias("n0"),
        F.avg(F.when(is_pos, F.col("x"))).alias("m1"), F.avg(F.when(~is_pos, F.col("x"))).alias("m0"),
        F.var_samp(F.when(is_pos, F.col("x"))).alias("v1"), F.var_samp(F.when(~is_pos, F.col("x"))).alias("v0"))
    dof = F.col("n1") + F.col("n0") - 2
    sp2 = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / dof
    tstat = (F.col("m1") - F.col("m0")) / F.sqrt(sp2 * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n0")))
    out = s.select("feature", "n1", "n0", tstat.alias("t"), dof.cast("bigint").alias("dof"))
    if with_p:
        out = out.withColumn("p_value", t_pvalue_udf(F.col("t"), F.col("dof").cast("double")))
    return out


def decimal_places(df: DataFrame, cols: list[str]) -> DataFrame:
    """FN3: max and mean number of printed decimal places per column over
    ALL rows (the reference looked at the first row only)."""
    def places(c):
        s = F.col(c).cast("string")
        return F.when(F.instr(s, ".") > 0, F.length(F.substring_index(s, ".", -1))).otherwise(0)
    aggs = [e for i, c in enumerate(cols) for e in (F.max(places(c)).alias(f"mx{i}"), F.avg(places(c)).alias(f"av{i}"))]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"mx{i}").alias("max_places"),
                 F.col(f"av{i}").alias("mean_places")) for i, c in enumerate(cols)])).alias("s")).select("s.*")


def issue_list(checks: DataFrame) -> DataFrame:
    """PR16: keep the rows of a (check, value, limit, flagged) table that are flagged."""
    return checks.where(F.col("flagged"))


def all_true(df: DataFrame, col: str) -> DataFrame:
    """AG17: bool_and over a flag column."""
    return df.agg(F.bool_and(F.col(col)).alias(f"all_{col}"))
