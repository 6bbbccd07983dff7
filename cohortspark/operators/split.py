"""Deterministic splits, folds and bootstrap weights (SP1-SP6, S13, S14).

Row membership comes from a portable 60-bit hash of (seed, key): the same
number in Spark (``conv(substr(md5(..), 1, 15), 16, 10)``) and DuckDB
(``('0x' || substr(md5(..), 1, 15))::BIGINT``). Assignment is a per-row
expression: no sort, no window over a class, no shuffle, and it does not
depend on partitioning, so re-running a lost task gives the same rows.
Per-class proportions hold in expectation (the hash is independent of the
label); counts deviate by binomial noise only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 60
HASH_SPACE = 1 << HASH_BITS


def _hash60_str(key: list[str], seed: int = 42, salt: str | None = None) -> str:
    parts = [f"'{seed}'"] + ([f"'{salt}'"] if salt is not None else []) + [f"CAST(`{k}` AS STRING)" for k in key]
    return f"CAST(conv(substring(md5(concat_ws(':', {', '.join(parts)})), 1, 15), 16, 10) AS BIGINT)"


def hash60(key: list[str], seed: int = 42, salt: str | None = None) -> Column:
    return F.expr(_hash60_str(key, seed, salt))


def hash60_sql(key: list[str], seed: int = 42, salt: str | None = None) -> str:
    parts = [f"'{seed}'"] + ([f"'{salt}'"] if salt is not None else []) + [f"CAST({k} AS VARCHAR)" for k in key]
    joined = " || ':' || ".join(parts)
    return f"('0x' || substr(md5({joined}), 1, 15))::BIGINT"


def cut_points(fractions: list[float]) -> list[int]:
    """Cumulative integer hash thresholds for the given split fractions."""
    acc, cuts = 0.0, []
    for f in fractions[:-1]:
        acc += f
        cuts.append(int(acc * HASH_SPACE))
    return cuts


def split_column(key: list[str], names: list[str], fractions: list[float], seed: int = 42) -> Column:
    """SP1 / SP2: split name per row ('train' / 'val' / 'test' ...)."""
    h = hash60(key, seed)
    expr = F.lit(names[-1])
    for name, cut in reversed(list(zip(names[:-1], cut_points(fractions)))):
        expr = F.when(h < F.lit(cut), F.lit(name)).otherwise(expr)
    return expr


def assign_split(df: DataFrame, key: list[str], names=("train", "test"), fractions=(0.7, 0.3),
                 seed: int = 42, out: str = "split") -> DataFrame:
    return df.withColumn(out, split_column(key, list(names), list(fractions), seed))


def fold_column(key: list[str], k: int, seed: int = 42, salt: str = "fold") -> Column:
    """SP4: fold id 0..k-1 from an independent hash (salted) of the key."""
    step = -(-HASH_SPACE // k)
    return F.expr(f"CAST(least({_hash60_str(key, seed, salt)} div {step}, {k - 1}) AS INT)")


def assign_folds(df: DataFrame, key: list[str], k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    return df.withColumn(out, fold_column(key, k, seed))


def group_folds(df: DataFrame, group: str, out: str = "fold") -> tuple[DataFrame, DataFrame]:
    """SP5: leave-one-group-out fold = position of the group in sorted order. The distinct groups are
    numbered (``running_total``), stored and joined back; any number of groups will do. The stored table's size is known, so
    a small one is broadcast and the rows are not shuffled by group. NULL groups get a NULL fold (S24). Returns the
    frame and the (group, fold) table."""
    from cohortspark.operators.ranking import running_total
    from cohortspark.session import stored
    groups = df.select(F.col(group).alias("__g")).where(F.col("__g").isNotNull()).distinct()
    table = stored(running_total(groups, [], [F.col("__g")], F.lit(1).cast("long"), "__at").select(
        "__g", (F.col("__at") - 1).cast("int").alias(out)), "group-folds")
    return df.join(table, F.col(group) == F.col("__g"), "left").drop("__g"), table.withColumnRenamed("__g", group)


def split_report(df: DataFrame, split: str, label: str) -> DataFrame:
    """SP3: rows per (split, class) with % of the split and of the class, and the split's rows."""
    from pyspark.sql import Window
    c = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    return (c.withColumn("pct_of_split", F.col("n") / F.sum("n").over(Window.partitionBy(split)) * 100)
            .withColumn("pct_of_class", F.col("n") / F.sum("n").over(Window.partitionBy(label)) * 100)
            .withColumn("split_rows", F.sum("n").over(Window.partitionBy(split))))


# Integer mixing for per-replicate uniforms: all arithmetic stays below 2^62,
# so Spark and DuckDB compute identical values (no overflow, no floats).
MIX_P = 2147483647  # 2^31 - 1
MIX_G, MIX_A, MIX_C1, MIX_C2 = 1000003, 48271, 12345, 67890


def _poisson_cuts_p(kmax: int = 12) -> list[int]:
    cdf, p, cuts = 0.0, math.exp(-1.0), []
    for k in range(kmax):
        cdf += p
        cuts.append(int(cdf * MIX_P))
        p = p / (k + 1)
    return cuts


POISSON_CUTS_P = _poisson_cuts_p()


def bootstrap_rows(df: DataFrame, key: list[str], keep: list[Column], replicates: int, seed: int = 42) -> DataFrame:
    """Every row once per replicate with its Poisson(1) weight ``__w``. The md5 base is computed once per
    row BEFORE the replicates are generated (``explode(sequence)``); each mixing step is its own projection
    so the weight expression is not re-inlined. Meant for an aggregate right after it."""
    p = F.lit(MIX_P)
    base = df.select((hash60(key, seed, "boot") % p).alias("__b"), *keep)
    names = base.columns[1:]
    rep = base.select(F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"), "__b", *names)
    x = rep.select("replicate", *names, ((F.col("__b") + F.col("replicate").cast("bigint") * F.lit(MIX_G)) % p).alias("__x"))
    x = x.select("replicate", *names, ((F.col("__x") * F.col("__x") + F.lit(MIX_C1)) % p).alias("__x"))
    x = x.select("replicate", *names, ((F.col("__x") * F.lit(MIX_A) + F.lit(MIX_C2)) % p).alias("__x"))
    x = x.select("replicate", *names, ((F.col("__x") * F.col("__x") + F.lit(MIX_C1)) % p).alias("__u"))
    w = F.lit(0)
    for c in POISSON_CUTS_P:
        w = w + (F.col("__u") >= F.lit(c)).cast("int")
    return x.select("replicate", *names, w.alias("__w"))


def bootstrap_accuracy(df: DataFrame, key: list[str], label: str, pred: str, replicates: int = 100,
                       seed: int = 42) -> DataFrame:
    """SP6: per-replicate weighted accuracy. A partial aggregate consumes the replicates inside the scan
    pipeline, so only replicates x partitions rows are shuffled."""
    x = bootstrap_rows(df, key, [(F.col(label) == F.col(pred)).cast("int").alias("__ok")], replicates, seed)
    return x.groupBy("replicate").agg((F.sum(F.col("__w") * F.col("__ok")) / F.sum("__w")).alias("accuracy"),
                                      F.sum("__w").alias("n_drawn"))


def bootstrap_binary(df: DataFrame, key: list[str], label: str, pred: str, score: str, replicates: int = 100,
                     seed: int = 42) -> DataFrame:
    """SP6: weighted accuracy, F1 and exact ROC-AUC of 0/1 labels in every replicate."""
    from cohortspark.operators.metrics import grouped_auc
    y, p = F.col("__y"), F.col("__p")
    x = bootstrap_rows(df, key, [F.col(label).alias("__y"), F.col(pred).alias("__p"), F.col(score).cast("double").alias("__score")],
                       replicates, seed)
    total = lambda cond: F.sum(F.when(cond, F.col("__w")).otherwise(0))
    m = x.groupBy("replicate").agg((total(y == p) / F.sum("__w")).alias("accuracy"),
                                   F.try_divide(2 * total((y == 1) & (p == 1)), total(y == 1) + total(p == 1)).alias("f1"))
    auc = grouped_auc(x, ["replicate"], y == 1, F.col("__score"), F.col("__w"))
    return m.join(auc.select("replicate", "auc"), "replicate")


def bootstrap_summary(reps: DataFrame, col: str = "accuracy") -> DataFrame:
    """SP6: mean, population std and 95 % percentile interval over replicates
    (the replicate table has ``replicates`` rows, so exact percentiles are cheap)."""
    return reps.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"),
                    F.percentile(col, 0.025).alias("ci_low"), F.percentile(col, 0.975).alias("ci_high"),
                    F.count(F.lit(1)).alias("replicates"))


BUCKET_SHIFT = 40  # 2^20 hash buckets per class


def exact_stratified_split(df: DataFrame, key: list[str], label: str, names=("train", "test"),
                           fractions=(0.7, 0.3), seed: int = 42, out: str = "split") -> DataFrame:
    """SP1 / SP2 with exact per-class counts: within each class, rows ranked by
    (hash60(seed, key), key) take split j while rank <= ceil(F_j * n_class)
    (F_j = cumulative fraction) — the textbook row_number() definition —
    computed without sorting a class in one task:

    1. counts per (class, hash bucket) — at most 2^20 buckets per class — and
       a running sum locate, for every cut, the bucket holding the cut rank;
    2. only the rows of those few buckets are ranked (a window over one
       bucket), giving the exact (hash, key) threshold of every cut;
    3. the split is a per-row expression comparing (hash, key) with the
       class's thresholds (literals).
    """
    from pyspark.sql import Window
    h = hash60(key, seed)
    cls = F.to_json(F.struct(F.col(label).alias("y")))   # never NULL, so NULL is a class like the others
    x = df.select(cls.alias("__y"), h.alias("__h"), *[F.col(k) for k in key])
    x = x.withColumn("__b", F.shiftright("__h", BUCKET_SHIFT))
    counts = x.groupBy("__y", "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__y").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counts.withColumn("__cum", F.sum("__n").over(w)).withColumn(
        "__tot", F.sum("__n").over(Window.partitionBy("__y")))
    cuts = []  # (class, cut index, rank R)
    totals = {r["__y"]: r["__tot"] for r in cum.select("__y", "__tot").distinct().collect()}
    acc = 0.0
    cum_fracs = []
    for f in fractions[:-1]:
        acc += f
        cum_fracs.append(acc)
    for y, n in totals.items():
        for j, fj in enumerate(cum_fracs):
            cuts.append((y, j, int(math.ceil(fj * n - 1e-9))))
    if not cuts:
        return df.withColumn(out, F.lit(names[-1]))
    spark = df.sparkSession
    cut_df = spark.createDataFrame(cuts, f"__y {x.schema['__y'].dataType.simpleString()}, __j int, __r long")
    # the bucket holding rank R: cum - n < R <= cum
    where = (cum.join(F.broadcast(cut_df), "__y")
             .where((F.col("__cum") - F.col("__n") < F.col("__r")) & (F.col("__r") <= F.col("__cum")))
             .select("__y", "__j", "__b", (F.col("__r") - (F.col("__cum") - F.col("__n"))).alias("__pos")))
    wanted = where.collect()  # classes x cuts rows
    wanted_df = spark.createDataFrame([(r["__y"], r["__j"], r["__b"], r["__pos"]) for r in wanted],
                                      f"__y {x.schema['__y'].dataType.simpleString()}, __j int, __b long, __pos long")
    in_cut = x.join(F.broadcast(wanted_df.select("__y", "__b").distinct()), ["__y", "__b"])
    ranked = in_cut.withColumn("__rk", F.row_number().over(
        Window.partitionBy("__y", "__b").orderBy("__h", *[F.col(k) for k in key])))
    th = ranked.join(F.broadcast(wanted_df), ["__y", "__b"]).where(F.col("__rk") == F.col("__pos")) \
        .select("__y", "__j", "__h", *[F.col(k) for k in key]).collect()
    thresholds = {(r["__y"], r["__j"]): (r["__h"], [r[k] for k in key]) for r in th}

    def le(y, j):
        hv, kv = thresholds[(y, j)]
        # (h, key) <= (hv, kv) in lexicographic order
        cond = F.lit(True)
        for k, v in reversed(list(zip(key, kv))):
            cond = (F.col(k) < F.lit(v)) | ((F.col(k) == F.lit(v)) & cond)
        return (h < F.lit(hv)) | ((h == F.lit(hv)) & cond)

    expr = F.lit(names[-1])
    for y in totals:
        per = F.lit(names[-1])
        for j in reversed(range(len(cum_fracs))):
            if (y, j) in thresholds:
                per = F.when(le(y, j), F.lit(names[j])).otherwise(per)
        expr = F.when(cls == F.lit(y), per).otherwise(expr)
    return df.withColumn(out, expr)


def exact_stratified_folds(df: DataFrame, key: list[str], label: str, k: int = 5, seed: int = 42,
                           out: str = "fold") -> DataFrame:
    """SP4 with exact per-class fold sizes: fold j holds the class rows ranked
    (by hash, key) in (ceil(j/k n), ceil((j+1)/k n)]; same bucketed cut search
    as ``exact_stratified_split``."""
    x = exact_stratified_split(df, key, label, names=tuple(str(j) for j in range(k)),
                               fractions=tuple([1.0 / k] * k), seed=seed, out="__fold")
    return x.withColumn(out, F.col("__fold").cast("int")).drop("__fold")
