"""Feature engineering, encoding and scaling (FE1-FE16, PR6, FN1, FN2).

All derived columns are built in ONE ``select`` / ``withColumns`` (no chain of
40 ``withColumn`` plans). Fitted quantities (means, stds, min/max, category
levels) are a few numbers per column from one aggregation over the fitting
rows, applied as literals.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import EPS, clip, safe_log10
from cohortspark.session import cut_lineage

# Clinical constants of the engineered features (LAP waist
# offset 58 cm, VAI women's coefficients 36.58 / 1.89 / 0.81 / 1.52, LAP
# floor 0.01) and risk-bin thresholds (BMI >= 30, waist >= 88, TG >= 150, HDL < 50).
LAP_OFFSET = 58.0
VAI_A, VAI_B, VAI_TG, VAI_HDL = 36.58, 1.89, 0.81, 1.52
LAP_FLOOR = 0.01
BMI_OBESE, WAIST_RISK, TG_RISK, HDL_RISK = 30, 88, 150, 50

AT_ONCE = 8      # columns in one aggregation

DEFAULT_ROLES = {"waist": "waist_circumference", "tg": "triglycerides", "hdl": "hdl", "ldl": "ldl",
                 "tc": "total_cholesterol", "bmi": "bmi", "age": "age"}


def _r(roles: dict, k: str) -> Column:
    return F.col(roles.get(k, DEFAULT_ROLES[k])).cast("double")


def clinical_proxies(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """FE1: LAP, log10(TG/HDL), LDL/HDL and adiposity index; bare ratios give
    NULL where the reference got inf/NaN (S9)."""
    r = roles or DEFAULT_ROLES
    tg, hdl = _r(r, "tg"), _r(r, "hdl")
    return df.withColumns({
        "lap": (_r(r, "waist") - F.lit(LAP_OFFSET)) * tg,
        "log_tg_hdl": safe_log10(F.try_divide(tg, hdl)),
        "ldl_hdl_ratio": F.try_divide(_r(r, "ldl"), hdl),
        "adiposity_index": _r(r, "bmi") * _r(r, "waist"),
    })


def engineer_features(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """FE2-FE9: metabolic proxy, lipid ratios, log transforms, VAI, clipped
    LAP, TyG proxy, risk bins and their sum, interaction terms."""
    r = roles or DEFAULT_ROLES
    waist, tg, hdl, ldl, tc, bmi, age = (_r(r, k) for k in ("waist", "tg", "hdl", "ldl", "tc", "bmi", "age"))
    eps = F.lit(EPS)
    metabolic = waist * tg / (hdl + eps)
    vai = (waist / (F.lit(VAI_A) + F.lit(VAI_B) * bmi)) * (tg / F.lit(VAI_TG)) * (F.lit(VAI_HDL) / (hdl + eps))
    lap = clip(waist - F.lit(LAP_OFFSET), lo=LAP_FLOOR) * tg
    bmi_obese = (bmi >= BMI_OBESE).cast("int")
    wc_risk = (waist >= WAIST_RISK).cast("int")
    tg_risk = (tg >= TG_RISK).cast("int")
    hdl_risk = (hdl < HDL_RISK).cast("int")
    return df.withColumns({
        "metabolic_proxy": metabolic,
        "ldl_hdl_ratio": ldl / (hdl + eps),
        "tc_hdl_ratio": tc / (hdl + eps),
        "trig_hdl_ratio": tg / (hdl + eps),
        "bmi_age": bmi * age,
        "log_trig": F.log1p(tg),
        "log_bmi": F.log1p(bmi),
        "vai": vai,
        "lap": lap,
        "tyg_proxy": F.ln(clip(tg, lo=1.0)) * F.ln(clip(bmi, lo=1.0)),
        "bmi_obese": bmi_obese, "wc_risk": wc_risk, "tg_risk": tg_risk, "hdl_risk": hdl_risk,
        "met_syndrome_count": wc_risk + tg_risk + hdl_risk + bmi_obese,
        "waist_age": waist * age,
        "bmi_trig": bmi * tg,
        "waist_sq": waist * waist,
        "bmi_sq": bmi * bmi,
        "waist_bmi_ratio": waist / (bmi + eps),
        "wc_hdl": waist / (hdl + eps),
        "bmi_hdl": bmi / (hdl + eps),
        "log_lap": F.log1p(lap),
        "log_metabolic": F.log1p(clip(metabolic, lo=0.0)),
        "log_vai": F.log1p(clip(vai, lo=0.0)),
        "wc_trig": waist * tg,
        "bmi_wc_hdl": bmi * waist / (hdl + eps),
    })


ENGINEERED = ["metabolic_proxy", "ldl_hdl_ratio", "tc_hdl_ratio", "trig_hdl_ratio", "bmi_age", "log_trig",
              "log_bmi", "vai", "lap", "tyg_proxy", "bmi_obese", "wc_risk", "tg_risk", "hdl_risk",
              "met_syndrome_count", "waist_age", "bmi_trig", "waist_sq", "bmi_sq", "waist_bmi_ratio", "wc_hdl",
              "bmi_hdl", "log_lap", "log_metabolic", "log_vai", "wc_trig", "bmi_wc_hdl"]


# The raw inputs and the columns that each nested feature set adds (FE11).
BASE_SET = ["age", "bmi", "total_cholesterol", "ldl", "hdl", "triglycerides", "waist_circumference"]
SET_STEPS = [
    ("1. Baseline (raw only)", []),
    ("2. + Metabolic Proxy", ["metabolic_proxy"]),
    ("3. + Lipid Ratios", ["ldl_hdl_ratio", "tc_hdl_ratio", "trig_hdl_ratio"]),
    ("4. + BMI*Age + Log", ["bmi_age", "log_trig", "log_bmi"]),
    ("5. + Clinical Indices", ["vai", "lap", "tyg_proxy", "bmi_obese", "wc_risk", "tg_risk", "hdl_risk", "met_syndrome_count"]),
]


def nested_feature_sets(base: list[str], top: list[str], degree: int = 3) -> dict[str, list[str]]:
    """FE11: seven feature sets, each holding the one before: the raw inputs, four named steps, all
    engineered columns, and the products of the ``top`` columns up to ``degree``."""
    sets, held = {}, list(base)
    for name, added in SET_STEPS:
        held = held + added
        sets[name] = held
    everything = list(base) + ENGINEERED
    sets["6. + All Interactions"] = everything
    sets["7. Full + Polynomial"] = everything + ["*".join(c) for c in interaction_names(top, degree)]
    return sets


def top_correlated(df: DataFrame, cols: list[str], target: str, n: int = 5) -> list[str]:
    """FE10 selection: the ``n`` columns with the largest absolute correlation with the target (ties by
    name), from one aggregation."""
    y = F.col(target).cast("double")
    r = _by_column(df, {c: [F.abs(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))]
                        for c, x in ((c, F.col(c).cast("double")) for c in cols)})
    r = {c: v for c, (v,) in r.items()}
    return sorted(cols, key=lambda c: (-(r[c] if r[c] is not None and r[c] == r[c] else -1.0), c))[:n]


def interaction_names(cols: list[str], degree: int = 2) -> list[tuple[str, ...]]:
    """Column combinations of size 2..degree, in itertools order."""
    return [combo for k in range(2, degree + 1) for combo in combinations(cols, k)]


def interaction_terms(cols: list[str], degree: int = 2) -> dict[str, Column]:
    """FE10: interaction-only products of 2..degree distinct columns (no
    squares, unlike PolynomialExpansion); names join inputs with '*'."""
    out = {}
    for combo in interaction_names(cols, degree):
        e = F.col(combo[0]).cast("double")
        for c in combo[1:]:
            e = e * F.col(c).cast("double")
        out["*".join(combo)] = e
    return out


def fit_standard(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """FE12 fit: mean and POPULATION std per column (S6)."""
    return _by_column(df, {c: [F.avg(x), F.stddev_pop(x)] for c, x in ((c, F.col(c).cast("double")) for c in cols)})


def _by_column(df: DataFrame, aggs: dict[str, list[Column]]) -> dict[str, tuple]:
    """The aggregates of each column, of ``AT_ONCE`` columns in one aggregation: an update of more buffers than that is
    too long a method for the JVM to compile, and rows stored by column are read once all the same."""
    names = list(aggs)

    def some(part: list[str]) -> dict[str, tuple]:
        row = df.agg(*[e.alias(f"a{i}_{j}") for i, c in enumerate(part) for j, e in enumerate(aggs[c])]).first()
        return {c: tuple(row[f"a{i}_{j}"] for j in range(len(aggs[c]))) for i, c in enumerate(part)}

    with ThreadPoolExecutor(3) as pool:
        parts = pool.map(some, [names[i:i + AT_ONCE] for i in range(0, len(names), AT_ONCE)])
        return {c: v for p in parts for c, v in p.items()}


def apply_standard(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """FE12 transform: (x - mean) / std, a zero std maps to 0 (sklearn)."""
    out = {}
    for c, (m, s) in params.items():
        x = F.col(c).cast("double") - F.lit(m)
        out[c + suffix] = x / F.lit(s) if s else x * 0.0
    return df.withColumns(out)


def fit_minmax(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}"))]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def apply_minmax(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """FE13 / FE14: (x - min) / (max - min); a constant column gives 0 (S7)."""
    out = {}
    for c, (lo, hi) in params.items():
        x = F.col(c).cast("double") - F.lit(lo)
        out[c + suffix] = x / F.lit(hi - lo) if hi is not None and hi != lo else x * 0.0
    return df.withColumns(out)


MAX_LEVELS = 10_000


def fit_levels(df: DataFrame, cols: list[str], most: int = MAX_LEVELS) -> dict[str, list]:
    """FE15 fit: sorted distinct levels per column from the fitting rows, in one distributed distinct. One level is
    one output column, so a column with more than ``most`` of them is refused before any level is collected."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)])))
    levels = cut_lineage(long.where(F.col("v").isNotNull()).distinct())
    sizes = {r["i"]: r["n"] for r in levels.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    for i, n in sizes.items():
        if n > most:
            raise ValueError(f"{cols[i]} has {n} levels, more than {most}")
    kinds = [df.schema[c].dataType for c in cols]
    row = levels.agg(*[F.sort_array(F.collect_set(F.when(F.col("i") == i, F.col("v").cast(k)))).alias(f"l{i}")
                       for i, k in enumerate(kinds)]).first()
    return {c: list(row[f"l{i}"]) for i, c in enumerate(cols)}


def apply_one_hot(df: DataFrame, levels: dict[str, list], drop_first: bool = True) -> DataFrame:
    """FE15: dummies for levels[1:] (first level dropped, S11); unknown and
    NULL give all zeros."""
    out = {}
    for c, lv in levels.items():
        for v in (lv[1:] if drop_first else lv):
            out[f"{c}_{v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
    return df.withColumns(out)


def assemble(df: DataFrame, cols: list[str], out: str = "features", handle_invalid: str = "keep") -> DataFrame:
    """FE16: numeric columns -> ML vector (MLlib ``VectorAssembler``)."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid=handle_invalid).transform(df)


def feature_columns(df: DataFrame, exclude: list[str]) -> tuple[list[str], list[str]]:
    """PR13 for FE16: (numeric, string) columns of the table without the excluded ones."""
    from cohortspark.operators.profile import numeric_columns, string_columns
    return ([c for c in numeric_columns(df) if c not in exclude], [c for c in string_columns(df) if c not in exclude])


class _ColumnParams(Params):
    """The columns of a transformer as Spark ML params, so that a parameter map can change them in a search."""

    numericCols = Param(Params._dummy(), "numericCols", "numeric columns, standardised", TypeConverters.toListString)
    stringCols = Param(Params._dummy(), "stringCols", "string columns, as drop-first dummies", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "name of the vector column", TypeConverters.toString)
    knownScales = Param(Params._dummy(), "knownScales", "(mean, std) by column, fitted before on the same rows", TypeConverters.identity)

    def __init__(self):
        super().__init__()
        self._setDefault(numericCols=[], stringCols=[], outputCol="features", knownScales={})


class ColumnTransformer(Estimator, _ColumnParams, DefaultParamsReadable, DefaultParamsWritable):
    """FE16 as a fitted pipeline stage: numeric columns standardised with the fitting rows' mean and
    population std, string columns as drop-first dummies of the fitting rows' levels (unknown levels and
    NULL are all zeros), in that order in one vector. Inside a ``Pipeline`` it is refitted in every
    cross-validation fold. A NULL number becomes the mean (0). The columns are params: a search over feature
    sets is a list of parameter maps, and stage and model can be saved. ``knownScales`` spares the pass over the rows for
    columns whose mean and std on the same rows are known (``tuning.shared_scales``)."""

    def __init__(self, numeric: list[str] | None = None, strings: list[str] | None = None, out: str = "features"):
        super().__init__()
        self._set(numericCols=list(numeric or []), stringCols=list(strings or []), outputCol=out)

    def _fit(self, dataset: DataFrame) -> "ColumnTransformerModel":
        numeric, strings = self.getOrDefault("numericCols"), self.getOrDefault("stringCols")
        scale = dict(self.getOrDefault("knownScales"))
        unknown = [c for c in numeric if c not in scale]
        scale |= fit_standard(dataset, unknown) if unknown else {}
        levels = fit_levels(dataset, strings) if strings else {}
        model = self._copyValues(ColumnTransformerModel())
        model.clear(model.knownScales)
        return model._set(means=[scale[c][0] for c in numeric], stds=[scale[c][1] for c in numeric],
                          levels=[levels[c] for c in strings])


class ColumnTransformerModel(Model, _ColumnParams, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted means, stds and levels, applied as literals in one projection."""

    means = Param(Params._dummy(), "means", "mean of each numeric column", TypeConverters.identity)
    stds = Param(Params._dummy(), "stds", "population std of each numeric column", TypeConverters.identity)
    levels = Param(Params._dummy(), "levels", "sorted levels of each string column", TypeConverters.identity)

    def __init__(self):
        super().__init__()
        self._setDefault(means=[], stds=[], levels=[])

    def columns(self) -> dict[str, Column]:
        """name -> transformed column, in vector order."""
        get, cols = self.getOrDefault, {}
        for c, m, s in zip(get("numericCols"), get("means"), get("stds")):
            x = F.col(f"`{c}`").cast("double") - F.lit(m)
            cols[c] = F.coalesce(x / F.lit(s) if s else x * 0.0, F.lit(0.0))
        for c, lv in zip(get("stringCols"), get("levels")):
            for v in lv[1:]:
                cols[f"{c}_{v}"] = F.coalesce((F.col(f"`{c}`") == F.lit(v)).cast("double"), F.lit(0.0))
        return cols

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector
        return dataset.withColumn(self.getOrDefault("outputCol"), array_to_vector(F.array(*self.columns().values())))
