"""Entropy and information gain (EN1-EN18).

The reference scans the table once per (feature x value); here every feature
is binned in one projection, unpivoted to (feature, bin, target) and counted
in ONE grouped aggregation with map-side partial aggregation. Everything after
that runs on the counts table, whose size is features x bins x classes and
does not grow with the row count.

Entropy identities used on the counts table (c = count of (bin, class)):
    n * H = n * log2(n) - sum(c * log2(c))
so conditional entropy needs no per-bin window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.quantiles import (
    bin_by_edges, equal_width_edges, qcut_edges,
)

# Purity thresholds on normalised entropy (.3 / .7) and on
# absolute entropy (.5 / .9); gain tiers (> .1 high, > .01 moderate).
NORMALISED_PURITY_CUTS = (0.3, 0.7)
ABSOLUTE_PURITY_CUTS = (0.5, 0.9)
GAIN_TIER_CUTS = (0.1, 0.01)


def _xlog2x(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))


# The purity words of the entropy report.
PURITY_WORDS = ("Pure", "Relatively Pure", "Moderately Impure", "Highly Impure")


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """EN2: per class count, probability and entropy term -p*log2(p)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())   # one row per class
    return (counts
            .withColumn("p", F.col("n") / total.cast("double"))
            .withColumn("term", -F.col("p") * F.log2("p")))


def entropy_summary(df: DataFrame, target: str) -> DataFrame:
    """EN1 + EN3 + EN4: entropy (bits), classes, max entropy log2(k),
    normalised entropy, both purity classes and the probability-sum check."""
    dist = class_distribution(df, target)
    s = dist.agg(
        F.sum("term").alias("entropy"),
        F.count(F.lit(1)).alias("n_classes"),
        F.sum("n").alias("n_rows"),
        F.sum("p").alias("prob_sum"))
    lo, hi = NORMALISED_PURITY_CUTS
    alo, ahi = ABSOLUTE_PURITY_CUTS
    return (s
            .withColumn("max_entropy", F.when(F.col("n_classes") > 1, F.log2(F.col("n_classes")))
                        .otherwise(F.lit(0.0)))
            .withColumn("normalised_entropy", F.coalesce(F.try_divide(F.col("entropy"), F.col("max_entropy")), F.lit(0.0)))
            .withColumn("purity", F.when(F.col("entropy") == 0, PURITY_WORDS[0])
                        .when(F.col("normalised_entropy") < lo, PURITY_WORDS[1])
                        .when(F.col("normalised_entropy") < hi, PURITY_WORDS[2])
                        .otherwise(PURITY_WORDS[3]))
            .withColumn("purity_absolute", F.when(F.col("entropy") == 0, "pure")
                        .when(F.col("entropy") < alo, "relatively pure")
                        .when(F.col("entropy") < ahi, "moderate impurity")
                        .otherwise("high impurity")))


def feature_entropies(df: DataFrame, cols: list[str]) -> DataFrame:
    """EN5: entropy of every column's value distribution (NULLs dropped),
    one grouped count over the unpivoted table, ranked descending."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "feature", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy("feature").agg(
        F.sum("c").alias("n"), F.sum(_xlog2x(F.col("c"))).alias("s"),
        F.count(F.lit(1)).alias("n_values"))
    ent = per.select("feature", "n_values",
                     (F.log2(F.col("n")) - F.col("s") / F.col("n")).alias("entropy"))
    return ent.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("entropy").desc(), F.col("feature"))))


def row_entropy(cols: list[str]) -> Column:
    """EN6: entropy of one row's positive values normalised to sum 1;
    0 when no value is positive. The column list is known when the plan is
    built, so the sums are written out term by term (left to right): plain
    arithmetic that whole-stage codegen compiles, unlike array lambdas."""
    xs = [F.col(c).cast("double") for c in cols]
    pos = [F.when(x > 0, x).otherwise(F.lit(0.0)) for x in xs]
    total = pos[0]
    for x in pos[1:]:
        total = total + x
    terms = [F.when(x > 0, -(x / total) * F.log2(x / total)).otherwise(F.lit(0.0)) for x in xs]
    h = F.lit(0.0)
    for term in terms:
        h = h + term
    any_pos = xs[0] > 0
    for x in xs[1:]:
        any_pos = any_pos | (x > 0)
    return F.when(F.coalesce(any_pos, F.lit(False)), h).otherwise(F.lit(0.0))


def binned_features(df: DataFrame, target: str, numeric: list[str], categorical: list[str],
                    binning: str = "quantile", bins: int = 5, method: str = "exact",
                    auto_distinct: int = 10) -> tuple[DataFrame, dict[str, list]]:
    """Project the target plus one string 'bin' column per feature.

    binning: ``quantile`` (qcut, EN8), ``equal_width`` (cut, EN9) or ``auto``
    (as-is when at most ``auto_distinct`` distinct values, else quantile bins,
    EN10). Edges are computed by bounded distributed aggregations and applied
    as literal comparisons, so the projection stays inside whole-stage codegen.
    """
    as_is = list(categorical)
    to_bin = list(numeric)
    if binning == "auto" and numeric:
        nd = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in numeric]).first()
        as_is += [c for c in numeric if nd[c] <= auto_distinct]
        to_bin = [c for c in numeric if nd[c] > auto_distinct]
    if binning == "equal_width":
        edges = equal_width_edges(df, to_bin, bins)
    else:
        edges = qcut_edges(df, to_bin, bins, method=method)
    exprs = [F.col(target)]
    for c in numeric + categorical:
        if c in to_bin:
            exprs.append(bin_by_edges(F.col(c).cast("double"), edges[c]).cast("string").alias(c))
        else:
            exprs.append(F.col(c).cast("string").alias(c))
    return df.select(*exprs), edges


def information_gain(df: DataFrame, target: str, numeric: list[str], categorical: list[str] | None = None,
                     binning: str = "quantile", bins: int = 5, null_policy: str = "drop",
                     method: str = "exact") -> DataFrame:
    """Information gain of every feature against ``target`` (EN11-EN14).

    null_policy (S4):
      * ``drop`` (default): rows whose feature/bin is NULL are left out of
        both H(T) and H(T|A) for that feature.
      * ``reference``: NULL rows stay in the weight denominator but join no
        subset (the reference's behaviour; inflates the gain).
      * ``target_all``: weights over non-NULL rows, H(T) over all rows (EN12).

    Output: feature, feature_type, information_gain, pct_base_entropy
    (gain / H(T over all rows) * 100), base_entropy, rank.
    """
    categorical = categorical or []
    feats = numeric + categorical
    binned, _ = binned_features(df, target, numeric, categorical, binning, bins, method)
    long = binned.unpivot([target], feats, "feature", "bin")
    counts = long.groupBy("feature", "bin", target).agg(F.count(F.lit(1)).alias("c"))
    nonnull = F.col("bin").isNotNull()

    # One counts table, no self-join: with c = count(feature, bin, class),
    # sum_b n_b log n_b = sum c log n_b, so every entropy term is a window sum
    # over the (small) counts table followed by one group-by feature.
    c = F.col("c")
    n_b = F.sum(F.when(nonnull, c)).over(Window.partitionBy("feature", "bin"))
    n_t_all = F.sum(c).over(Window.partitionBy("feature", target))
    n_t_nn = F.sum(F.when(nonnull, c)).over(Window.partitionBy("feature", target))
    terms = counts.select("feature", nonnull.alias("nn"), "c", n_b.alias("n_b"), n_t_all.alias("n_t_all"),
                          n_t_nn.alias("n_t_nn"))
    nn = F.col("nn")
    base = terms.groupBy("feature").agg(
        F.sum("c").alias("n_all"), F.sum(F.when(nn, c).otherwise(0)).alias("n_nn"),
        F.sum(c * F.log2("n_t_all")).alias("s_all"),
        F.sum(F.when(nn, c * F.log2("n_t_nn")).otherwise(0.0)).alias("s_nn"),
        F.sum(F.when(nn, c * (F.log2("n_b") - F.log2(c))).otherwise(0.0)).alias("cond_num"))
    h_all = F.log2(F.col("n_all")) - F.col("s_all") / F.col("n_all")
    h_nn = F.when(F.col("n_nn") > 0, F.log2(F.col("n_nn")) - F.col("s_nn") / F.col("n_nn"))
    cond_num = F.coalesce(F.col("cond_num"), F.lit(0.0))
    if null_policy == "drop":
        gain = h_nn - F.try_divide(cond_num, F.col("n_nn").cast("double"))
    elif null_policy == "reference":
        gain = h_all - cond_num / F.col("n_all")
    elif null_policy == "target_all":
        gain = h_all - F.try_divide(cond_num, F.col("n_nn").cast("double"))
    else:
        raise ValueError(f"unknown null_policy {null_policy!r}")
    types = F.create_map(*[x for f in feats for x in (
        F.lit(f), F.lit("numeric" if f in numeric else "categorical"))])
    res = (base
           .select("feature", types[F.col("feature")].alias("feature_type"),
                   F.coalesce(gain, F.lit(0.0)).alias("information_gain"),
                   h_all.alias("base_entropy")))
    res = res.withColumn("pct_base_entropy", F.when(
        F.col("base_entropy") > 0, F.col("information_gain") / F.col("base_entropy") * 100).otherwise(0.0))
    return res.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("information_gain").desc(), F.col("feature"))))


def gain_report(ig: DataFrame, top_n: int = 5) -> DataFrame:
    """EN15-EN18 on an ``information_gain`` table: tier, remaining entropy,
    top-n flag, best-3-within-type flag, above-mean flag, above-1 % flag."""
    hi, mid = GAIN_TIER_CUTS
    w_type = Window.partitionBy("feature_type").orderBy(F.col("information_gain").desc(), F.col("feature"))
    return (ig
            .withColumn("tier", F.when(F.col("information_gain") > hi, "high")
                        .when(F.col("information_gain") > mid, "moderate").otherwise("low"))
            .withColumn("remaining_entropy", F.col("base_entropy") - F.col("information_gain"))
            .withColumn("in_top_n", F.col("rank") <= top_n)
            .withColumn("type_rank", F.row_number().over(w_type))
            .withColumn("best_of_type", F.col("type_rank") <= 3)
            .withColumn("above_mean", F.col("information_gain") > F.avg("information_gain").over(Window.partitionBy()))
            .withColumn("above_one_pct", F.col("pct_base_entropy") > 1.0))
