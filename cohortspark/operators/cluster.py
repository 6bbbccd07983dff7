"""K-means phenotyping (CL1-CL12).

Fits are MLlib ``KMeans`` (k-means||, distributed Lloyd iterations); restarts
are independent seeded fits keeping the lowest training cost. Per-row
silhouettes use the squared-Euclidean definition MLlib evaluates, computed
exactly from per-cluster sufficient statistics (count, mean vector, sum of
squared norms) — k small rows joined by broadcast — instead of all pairs.
Labelling runs on the k-row median table.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Trait thresholds on cluster medians and the first-match
# decision list of phenotype labels.
TRAIT_RULES = [
    ("Poor Glycemic Control", "hba1c >= 7.0 OR fbs >= 126"),
    ("Mild Hyperglycemia", "NOT (hba1c >= 7.0 OR fbs >= 126) AND (hba1c >= 5.7 OR fbs >= 100)"),
    ("Severe Obesity", "bmi >= 35"),
    ("Obese", "bmi < 35 AND bmi >= 30"),
    ("Overweight", "bmi < 30 AND bmi >= 25"),
    ("Dyslipidemia", "total_cholesterol >= 240 OR ldl >= 160"),
    ("Borderline Lipids", "NOT (total_cholesterol >= 240 OR ldl >= 160) AND (total_cholesterol >= 200 OR ldl >= 130)"),
    ("High Triglycerides", "triglycerides >= 200"),
    ("Low HDL", "hdl < 40"),
    ("Hypertensive", "systolic >= 140 OR diastolic >= 90"),
    ("Elevated BP", "NOT (systolic >= 140 OR diastolic >= 90) AND (systolic >= 130 OR diastolic >= 85)"),
    ("Older", "age >= 58"),
    ("Younger", "age < 58 AND age <= 48"),
    ("Central Obesity", "waist_circumference >= 110"),
]
PHENOTYPE_ORDER = [
    ("Poor Glycemic Control", "array_contains(traits, 'Poor Glycemic Control')"),
    ("Severe Insulin-Resistant / Obesity-Related Diabetes (SIROD)",
     "array_contains(traits, 'Severe Obesity') OR (array_contains(traits, 'Central Obesity') AND array_contains(traits, 'Obese'))"),
    ("Hypertensive Metabolic Syndrome", "array_contains(traits, 'Hypertensive')"),
    ("Mild Age-Related Diabetes (MARD)",
     "array_contains(traits, 'Older') AND NOT (array_contains(traits, 'Obese') OR array_contains(traits, 'Severe Obesity'))"),
    ("Dyslipidemic Phenotype", "array_contains(traits, 'Dyslipidemia') OR array_contains(traits, 'High Triglycerides')"),
    ("Younger Obese / Moderate Metabolic Risk", "array_contains(traits, 'Obese') AND array_contains(traits, 'Younger')"),
    ("Moderate Metabolic Risk",
     "(array_contains(traits, 'Overweight') OR array_contains(traits, 'Obese')) AND array_contains(traits, 'Mild Hyperglycemia')"),
]
DEFAULT_PHENOTYPE = "Metabolically Healthier / Low-Risk"

# Rank-sum phenotype names and their display order, and the
# description lookup for each.
RANK_SUM_ORDER = ["SIDD", "SIRD", "MOD", "MARD"]
PHENOTYPE_DESCRIPTIONS = {
    "SIRD": "Severe Insulin-Resistant Diabetes",
    "SIDD": "Severe Insulin-Deficient Diabetes",
    "MARD": "Mild Age-Related Diabetes",
    "MOD": "Mild Obesity-Related Diabetes",
}


# The advice table, key features and recommendations of each rank-sum phenotype.
PHENOTYPE_ADVICE = {
    "SIRD": ("Highest LAP, TG/HDL ratio, waist circumference — visceral adiposity & severe insulin resistance.",
             "Weight loss (GLP-1 RA, bariatric referral) · Insulin sensitizers (metformin, pioglitazone) · CV risk management · "
             "Screen NAFLD/NASH & OSA"),
    "SIDD": ("Younger age, low/normal BMI — beta-cell dysfunction rather than obesity-driven resistance.",
             "Monitor beta-cell function (C-peptide, HOMA-B) · Early insulin/sulfonylurea consideration · Screen GAD65/IA-2 (rule out LADA) · "
             "Tight glycemic control"),
    "MARD": ("Oldest group, stable mild lipid profiles — age-related metabolic decline.",
             "Conservative glycemic targets · Geriatric syndrome screening · Simplified regimens · Periodic goal reassessment"),
    "MOD": ("Younger, moderate obesity (high BMI, lower LAP than SIRD) — obesity-driven but less metabolically severe.",
            "Structured weight management · Metformin first-line · Consider GLP-1 RA · Address modifiable risk factors · Behavioral counseling"),
}


def advice_table(spark) -> DataFrame:
    """CL12: the advice as a dimension table (phenotype, description, key_features, recommendations)."""
    rows = [(p, PHENOTYPE_DESCRIPTIONS[p], *PHENOTYPE_ADVICE[p]) for p in RANK_SUM_ORDER]
    return spark.createDataFrame(rows, "phenotype string, description string, key_features string, recommendations string")


def with_advice(labels: DataFrame, advice: DataFrame) -> DataFrame:
    """CL12: labelled rows with the columns of the advice table that they lack; phenotypes it does not know keep NULLs."""
    return labels.join(advice.select("phenotype", *[c for c in advice.columns if c not in labels.columns]), "phenotype", "left")


def fit_kmeans(df: DataFrame, features_col: str, k: int, seeds: list[int], max_iter: int = 300,
               init_steps: int = 2, tol: float = 1e-4):
    """CL1: fit once per seed, keep the model with the lowest training cost."""
    from pyspark.ml.clustering import KMeans
    best = None
    for s in seeds:
        m = KMeans(k=k, seed=s, maxIter=max_iter, initSteps=init_steps, tol=tol, featuresCol=features_col,
                   predictionCol="cluster").fit(df)
        if best is None or m.summary.trainingCost < best.summary.trainingCost:
            best = m
    return best


def k_sweep(df: DataFrame, features_col: str, ks: list[int], seeds: list[int], max_iter: int = 300, parallelism: int = 3) -> DataFrame:
    """CL2: WCSS (training cost) and squared-Euclidean silhouette for each k; several k at once, as a Lloyd iteration
    alone leaves cores idle."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    ev = ClusteringEvaluator(featuresCol=features_col, predictionCol="cluster", distanceMeasure="squaredEuclidean")

    def one(k: int) -> tuple[int, float, float]:
        m = fit_kmeans(df, features_col, k, seeds, max_iter)
        return k, float(m.summary.trainingCost), float(ev.evaluate(m.transform(df)))

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        rows = list(pool.map(one, ks))
    return df.sparkSession.createDataFrame(rows, "k int, wcss double, silhouette double")


def elbow(sweep: DataFrame) -> DataFrame:
    """CL4 / WN3: first and second differences of WCSS over ordered k; the
    elbow is the k with the largest |second difference|, plus best-silhouette k."""
    w = Window.orderBy("k")
    d1 = F.col("wcss") - F.lag("wcss").over(w)
    x = sweep.withColumn("d1", d1).withColumn("d2", F.col("d1") - F.lag("d1").over(w))
    whole = Window.partitionBy()
    return (x.withColumn("elbow_k", F.max_by("k", F.struct(F.abs(F.col("d2")), -F.col("k"))).over(whole))
            .withColumn("best_silhouette_k", F.max_by("k", F.struct(F.col("silhouette"), -F.col("k"))).over(whole)))


def silhouette_rows(df: DataFrame, key: list[str], feats: list[str], cluster: str = "cluster") -> DataFrame:
    """CL6 (squared Euclidean, exact): a(i) = mean squared distance to the
    other members of its cluster, b(i) = smallest mean squared distance to
    another cluster; s = (b - a) / max(a, b), 0 for singletons. Uses
    ||x - y||^2 = ||x||^2 - 2 x.y + ||y||^2 summed over a cluster."""
    x = [F.col(f).cast("double") for f in feats]
    norm = sum([c * c for c in x[1:]], x[0] * x[0])
    stats = df.groupBy(F.col(cluster).alias("__c")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(norm).alias("__s"),
        *[F.avg(c).alias(f"__m{i}") for i, c in enumerate(x)])
    rows = stats.collect()  # k rows
    me = df.select(*key, F.col(cluster), *[c.alias(f"__x{i}") for i, c in enumerate(x)], norm.alias("__nx"))
    dot = {}
    for r in rows:
        c = r["__c"]
        xm = sum([F.col(f"__x{i}") * F.lit(r[f"__m{i}"]) for i in range(1, len(feats))],
                 F.col("__x0") * F.lit(r["__m0"]))
        dot[c] = F.col("__nx") - 2 * xm + F.lit(r["__s"] / r["__n"])  # mean sq. distance to all of c
    own = F.lit(None).cast("double")
    n_own = F.lit(None).cast("long")
    for r in rows:
        c = r["__c"]
        own = F.when(F.col(cluster) == F.lit(c), dot[c] * F.lit(r["__n"]) / F.lit(max(r["__n"] - 1, 1))).otherwise(own)
        n_own = F.when(F.col(cluster) == F.lit(c), F.lit(r["__n"])).otherwise(n_own)
    others = [F.when(F.col(cluster) != F.lit(r["__c"]), dot[r["__c"]]) for r in rows]
    b = F.least(*others) if len(others) > 1 else others[0]
    s = F.when(n_own <= 1, F.lit(0.0)).otherwise((b - own) / F.greatest(own, b))
    return me.select(*key, F.col(cluster), own.alias("a"), b.alias("b"), s.alias("silhouette"))


PARTNERS = 256
MAX_CLUSTERS = 1_000
# half width of the stated interval in standard errors of a sampled mean
ERROR_WIDTH = 3.0


def euclid_silhouettes(df: DataFrame, key: list[str], feats: list[str], cluster: str = "cluster", partners: int = PARTNERS,
                       seed: int = 42) -> DataFrame:
    """CL6 / S15 by Euclidean distance, for every row: a(i) the mean distance to the other members of its cluster, b(i)
    the least mean distance to another cluster, s = (b - a) / max(a, b), 0 for singletons.

    Exact distances need all pairs, so each mean is taken over the ``partners`` members of a cluster with the
    least key hash: exact where a cluster has no more members, else the mean of a random sample. ``error`` bounds the
    silhouette: every sampled mean may be off by ``ERROR_WIDTH`` of its standard errors (sample variance, finite
    population), and the worst silhouette within these intervals is that far away; 0 where all means are exact.

    The partners (clusters x ``partners`` rows) are the only rows that leave their tasks; the distances are
    matrix blocks in Arrow batches. ``key`` tells rows apart. NULL features and clusters are left out."""
    from cohortspark.operators.split import hash60
    x = [F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(feats)]
    rows = df.select(*key, F.col(cluster), *x, hash60(key, seed, "silhouette").alias("__h")).dropna(subset=[cluster, *[f"__x{i}" for i in range(len(feats))]])
    sizes = {r[0]: r[1] for r in rows.groupBy(cluster).count().limit(MAX_CLUSTERS + 1).collect()}
    if len(sizes) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    nth = F.row_number().over(Window.partitionBy(cluster).orderBy("__h", *key))
    sample: dict = {c: [] for c in sizes}
    for r in rows.withColumn("__nth", nth).where(F.col("__nth") <= partners).collect():
        sample[r[cluster]].append(r)
    points = {c: np.array([[r[f"__x{i}"] for i in range(len(feats))] for r in v]) for c, v in sample.items()}
    last = {c: max(r["__h"] for r in v) for c, v in sample.items()}     # members up to this hash are partners
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{k}` {kind[k]}" for k in key], f"`{cluster}` {kind[cluster]}", "a double", "b double", "silhouette double", "error double"])

    def score(a, b):
        top = np.maximum(a, b)
        return np.divide(b - a, top, out=np.zeros_like(top), where=top > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                m = np.column_stack([batch[f"__x{i}"].to_numpy() for i in range(len(feats))])
                own, h = np.array(batch[cluster].to_pylist(), dtype=object), batch["__h"].to_numpy()
                a, ea = np.zeros(len(m)), np.zeros(len(m))
                b, low, high = (np.full(len(m), np.inf) for _ in range(3))
                for c, p in points.items():
                    d = np.sqrt(((m[:, None] - p[None]) ** 2).sum(axis=2))
                    mine = own == c
                    used = len(p) - (mine & (h <= last[c]))               # a partner does not meet itself
                    others = sizes[c] - mine
                    n = np.maximum(used, 1)
                    mean = d.sum(axis=1) / n
                    # its own distance 0 is no observation, so it is taken out of the squares as well
                    var = np.maximum(0, (d * d).sum(axis=1) - n * mean * mean) / np.maximum(n - 1, 1)
                    off = ERROR_WIDTH * np.sqrt(var / n * np.maximum(0.0, 1 - n / np.maximum(others, 1)))
                    a, ea = np.where(mine, mean, a), np.where(mine, off, ea)
                    b = np.where(mine, b, np.minimum(b, mean))
                    low = np.where(mine, low, np.minimum(low, mean - off))
                    high = np.where(mine, high, np.minimum(high, mean + off))
                alone = np.array([sizes[c] for c in own.tolist()]) <= 1
                single = len(points) == 1
                s = np.where(alone, 0.0, score(a, np.where(np.isinf(b), 0, b)))
                up, down = score(np.maximum(a - ea, 0), np.where(np.isinf(high), 0, high)), score(a + ea, np.maximum(np.where(np.isinf(low), 0, low), 0))
                error = np.where(alone, 0.0, np.maximum(np.maximum(up - s, s - down), 0))
                out = [pa.array(v, mask=np.full(len(m), single)) for v in (b, s, error)]
                yield pa.RecordBatch.from_arrays([*[batch[k] for k in key], batch[cluster], pa.array(a), *out], [*key, cluster, "a", "b", "silhouette", "error"])

    return rows.mapInArrow(run, schema)


def ranked_silhouettes(df: DataFrame, key: list[str], feats: list[str], cluster: str = "cluster") -> DataFrame:
    """CL6: ``silhouette_rows`` with the rank of each row inside its cluster."""
    from cohortspark.operators.profile import rank_within_group
    out = silhouette_rows(df, key, feats, cluster)
    return rank_within_group(out, [cluster], [F.col("silhouette").desc(), *[F.col(k) for k in key]],
                             out="rank_in_cluster")


def trait_labels(medians: DataFrame, cluster: str = "cluster") -> DataFrame:
    """CL8: trait tags from median thresholds, then the first matching
    phenotype of the decision list."""
    tags = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in TRAIT_RULES]))
    x = medians.withColumn("traits", tags)
    label = F.lit(DEFAULT_PHENOTYPE)
    for name, cond in reversed(PHENOTYPE_ORDER):
        label = F.when(F.expr(cond), F.lit(name)).otherwise(label)
    return x.withColumn("phenotype", label)


def avg_rank(col: str) -> Column:
    """WN2: average rank with ties (pandas ``rank()``) over the whole table."""
    w = Window.orderBy(F.col(col))
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(F.col(col))) - 1) / 2.0


def rank_sum_labels(medians: DataFrame, cluster: str = "cluster") -> DataFrame:
    """CL9 on the k-row median table: SIRD has the largest sum of ranks of LAP, log TG/HDL and waist; of
    the others MARD is the oldest; of those left MOD has the highest BMI; the rest are SIDD. Ties go to
    the lowest cluster id. Three windows over the k rows, each over the rows not yet named."""
    every = Window.partitionBy()
    c = F.col(cluster)

    def chosen(value: Column, free: Column) -> Column:
        return F.max_by(F.when(free, c), F.when(free, F.struct(value, -c))).over(every)

    x = medians.withColumn("__s", avg_rank("lap") + avg_rank("log_tg_hdl") + avg_rank("waist_circumference"))
    x = x.withColumn("__sird", chosen(F.col("__s"), F.lit(True)))
    x = x.withColumn("__mard", chosen(F.col("age"), c != F.col("__sird")))
    x = x.withColumn("__mod", chosen(F.col("bmi"), (c != F.col("__sird")) & (c != F.col("__mard"))))
    name = (F.when(c == F.col("__sird"), "SIRD").when(c == F.col("__mard"), "MARD").when(c == F.col("__mod"), "MOD")
            .otherwise("SIDD"))
    order = F.array_position(F.array(*[F.lit(lab) for lab in RANK_SUM_ORDER]), F.col("phenotype")).cast("int") - 1
    desc = F.create_map(*[v for pair in PHENOTYPE_DESCRIPTIONS.items() for v in map(F.lit, pair)])
    return (x.select(cluster, name.alias("phenotype")).withColumn("display_order", order)
            .withColumn("description", desc[F.col("phenotype")]))
