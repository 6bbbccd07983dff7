"""Exact, distributed quantiles and right-closed binning (S1, S2, EN8, EN9).

Spark's ``percentile`` aggregate keeps a value -> count map per group and merges it in one task.
``quantile_table`` reads the (group, value) rows twice instead, on one path for every size:

1. one grouped aggregation gives count, min, max and a bounded KLL sketch, whose
   values at p -+ margin bracket the wanted ranks, with ``CUTS`` cut values inside each bracket;
2. one grouped count keeps values inside a bracket and folds all rows of each gap between brackets
   into one entry with its count, least and greatest value.

The cut values order the entries into segments before they are shuffled: an entry's place is the rows of the
lower segments (a few numbers per group) plus its place in its own segment, which holds a small share
of a bracket. So there is no range partitioning, no sampling job and no stored copy of the entries. A rank
at the edge of a gap is its least or greatest value; should a sketch ever miss by more, that gap
becomes the bracket of another pass of step 2, until every rank is found.

``part_sketches`` keeps the state of step 1 as one mergeable KLL sketch per part and column: quantiles of
any set of parts come from the stored sketches, new parts add rows, and exact quantiles take their brackets
from them, with a single scan (``quantile_table(..., sketch=brackets_of(...))``).

Linear interpolation follows ``v[lo] + (v[hi] - v[lo]) * frac`` with ``h = (n - 1) * p`` (pandas /
DuckDB ``quantile_cont`` / Spark ``percentile``). NULL and NaN are missing values and ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import Window

from cohortspark.session import cut_lineage, stored

ACCURACY = 1_000
CUTS = 4
FALLBACK_CUTS = 64


def _kll_k(accuracy: int) -> int:
    """Size of a KLL sketch whose rank error is about 0.4 / accuracy (measured at 1,000), so that a margin of 1 / accuracy
    has room."""
    return max(8, min(65_535, 4 * accuracy))


def rank_margin(accuracy: int = ACCURACY) -> float:
    return 1.0 / accuracy



def present(c: Column) -> Column:
    """The value as double; NaN counts as missing."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def _exprs(cols) -> dict[str, Column]:
    if isinstance(cols, dict):
        return {k: present(v) for k, v in cols.items()}
    return {c: present(F.col(c)) for c in cols}


def to_long(df: DataFrame, cols, by: str | None = None) -> DataFrame:
    """(__g, __v) rows, one per present value of each named column or expression; with ``by`` also that
    column as ``__by`` (NULL is a group)."""
    ex = _exprs(cols)
    entries = F.array(*[F.struct(F.lit(n).alias("__g"), e.alias("__v")) for n, e in ex.items()])
    keep = [F.col(by).alias("__by")] if by else []
    return df.select(*keep, F.inline(entries)).where(F.col("__v").isNotNull())


def _same(keys: list[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def _grid(probs: list[float], margin: float) -> list[float]:
    """The ranks whose sketch values bracket every wanted rank and cut its bracket."""
    steps = [margin * (2 * i / CUTS - 1) for i in range(CUTS + 1)]
    return sorted({min(1.0, max(0.0, p + s)) for p in probs for s in steps})


def _brackets(sketch: DataFrame, keys: list[str], probs: list[float], margin: float) -> DataFrame:
    """keys, n, least, greatest, los and his (the bracket of each probability), cuts (distinct, ascending). The values
    ``s`` of the sketch are those of ``_grid``; its ends are the exact least and greatest value."""
    grid = _grid(probs, margin)
    at = {g: F.col("s")[i] for i, g in enumerate(grid)} | {0.0: F.col("least"), 1.0: F.col("greatest")}
    los = [at[min(1.0, max(0.0, p - margin))] for p in probs]
    his = [at[min(1.0, max(0.0, p + margin))] for p in probs]
    cuts = F.array_distinct(F.sort_array(F.array(*[at[g] for g in grid])))
    return sketch.select(*keys, "n", "least", "greatest", F.array(*los).alias("los"), F.array(*his).alias("his"), cuts.alias("cuts"))


def _entries(long: DataFrame, brackets: DataFrame, keys: list[str], m: int, n_cuts: int) -> DataFrame:
    """Counts of the values inside the ``m`` brackets of each group and of every gap: (keys, seg, gap, at, n,
    least, greatest). Segment ``seg`` holds the values behind ``seg`` cuts; it has at most one gap, and that
    lies below its values."""
    b = brackets.select(*keys, *[F.get("cuts", F.lit(i)).alias(f"c{i}") for i in range(n_cuts)],
                        *[F.col(e)[j].alias(f"{e[:2]}{j}") for j in range(m) for e in ("los", "his")])
    v, inside = F.col("l.__v"), F.lit(False)
    for j in range(m):
        inside = inside | v.between(F.col(f"b.lo{j}"), F.col(f"b.hi{j}"))

    def cuts_below(lo: int, hi: int) -> Column:
        """The number of cuts below v, known to be from ``lo`` to ``hi``: halved by one comparison at a time. A group with
        fewer cuts has NULLs behind them, which are below nothing."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(f"b.c{mid}") < v, cuts_below(mid + 1, hi)).otherwise(cuts_below(lo, mid))

    seg = cuts_below(0, n_cuts)
    placed = long.alias("l").join(b.alias("b"), _same(keys, "l", "b")).select(
        *[F.col(f"l.{k}").alias(k) for k in keys], inside.alias("__in"), seg.alias("seg"), v.alias("__v"))
    placed = placed.select(*keys, "seg", (~F.col("__in")).alias("gap"), F.when(F.col("__in"), F.col("__v")).alias("at"), "__v")
    return placed.groupBy(*keys, "seg", "gap", "at").agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("least"),
                                                         F.max("__v").alias("greatest"))


def _placed(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The entries with ``upto``: the rows of the group up to and including the entry."""
    inside = Window.partitionBy(*keys, "seg").orderBy(F.col("gap").desc(), "at").rowsBetween(Window.unboundedPreceding, 0)
    local = entries.withColumn("run", F.sum("n").over(inside))
    lower = Window.partitionBy(*keys).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)     # a few segments a group
    totals = entries.groupBy(*keys, "seg").agg(F.sum("n").alias("total"))
    totals = totals.select(*keys, "seg", F.coalesce(F.sum("total").over(lower), F.lit(0)).alias("before"))
    both = local.alias("a").join(totals.alias("t"), _same([*keys, "seg"], "a", "t"))
    return both.select(*[F.col(f"a.{k}").alias(k) for k in keys], "gap", "at", "n", "least", "greatest", (F.col("run") + F.col("before")).alias("upto"))


def sketch_table(long: DataFrame, probs: list[float], keys: list[str], accuracy: int = ACCURACY, moments: bool = False) -> DataFrame:
    """Step 1: keys, n, least, greatest, s (sketch values at the ranks of ``_grid``); with ``moments`` also n_missing, mean
    and sample std of the group from the same scan (``long`` may hold NULL values then)."""
    extra = [F.count_if(F.col("__v").isNull()).alias("n_missing"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("std")] if moments else []
    state = long.groupBy(*keys).agg(F.count("__v").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("greatest"),
                                    F.kll_sketch_agg_double("__v", _kll_k(accuracy)).alias("kll"), *extra)
    return state.withColumn("s", _sketched(_grid(probs, rank_margin(accuracy)))).drop("kll")


def _sketched(ranks: list[float]) -> Column:
    """The sketch values at some ranks; NULL for a group without values."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("kll", F.array(*[F.lit(float(r)) for r in ranks])))


def quantile_table(long: DataFrame, probs: list[float], keys: list[str] | None = None, accuracy: int = ACCURACY,
                   sketch: DataFrame | None = None, margin: float | None = None) -> DataFrame:
    """(keys, p, q, n, least, greatest): the exact quantiles of ``__v`` in every group of ``long``, a row per
    group and probability, with the group's count, minimum and maximum. ``sketch`` (keys, n, least,
    greatest, s) stands for step 1 where it is known already; ``margin`` is its rank error."""
    keys = keys or ["__g"]
    margin = margin or rank_margin(accuracy)
    if sketch is None:
        sketch = sketch_table(long, probs, keys, accuracy)
    brackets = stored(_brackets(sketch.where("n > 0"), keys, probs, margin), "quantile-brackets")
    long = long.where(F.col("__v").isNotNull())

    # the ranks of every group: p -> floor((n - 1) p) and the one above it
    h = (F.col("n") - 1) * F.col("w.p")
    low = F.least(F.floor(h), F.col("n") - 1)
    wanted = (brackets.select(*keys, "n", "least", "greatest", F.explode(F.array(*[
        F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("p")) for j, p in enumerate(probs)])).alias("w"))
        .withColumn("frac", h - low).withColumn("r", F.explode(F.array(
            F.struct(F.lit(0).alias("side"), low.alias("rank")),
            F.struct(F.lit(1).alias("side"), F.least(low + 1, F.col("n") - 1).alias("rank")))))
        .select(*keys, F.col("n").alias("size"), F.col("least").alias("min"), F.col("greatest").alias("max"), "w.j", "w.p", "frac",
                "r.side", "r.rank"))
    found, m, n_cuts = None, len(probs), len(_grid(probs, margin))
    while True:
        e = _placed(_entries(long, brackets, keys, m, n_cuts), keys)
        on = _same(keys, "w", "e") & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
        value = (F.when(~F.col("gap"), F.col("at")).when(F.col("rank") == F.col("upto") - F.col("n"), F.col("least"))
                 .when(F.col("rank") == F.col("upto") - 1, F.col("greatest")))
        hits = stored(wanted.alias("w").join(e.alias("e"), on).select(*[F.col(f"w.{c}").alias(c) for c in wanted.columns],
                                                                      value.alias("value"), "least", "greatest"), "quantile-hits")
        done = hits.where(F.col("value").isNotNull()).select(*wanted.columns, "value")
        found = done if found is None else found.unionByName(done)
        missed = hits.where(F.col("value").isNull())
        if missed.isEmpty():
            break
        # search the missed gaps whole, cut into equal widths
        wanted, m, n_cuts = missed.select(*wanted.columns), 1, FALLBACK_CUTS
        gap = missed.groupBy(*keys).agg(F.min("least").alias("lo"), F.max("greatest").alias("hi"))
        step = (F.col("hi") - F.col("lo")) / (FALLBACK_CUTS - 1)
        cuts = F.array(*[F.col("lo") + step * i for i in range(FALLBACK_CUTS - 1)], F.col("hi"))
        brackets = gap.select(*keys, F.array("lo").alias("los"), F.array("hi").alias("his"), F.array_distinct(F.sort_array(cuts)).alias("cuts"))
    both = found.groupBy(*keys, "j").agg(
        F.first("p").alias("p"), F.first("frac").alias("frac"), F.first("size").alias("n"), F.first("min").alias("least"),
        F.first("max").alias("greatest"), F.max(F.when(F.col("side") == 0, F.col("value"))).alias("a"),
        F.max(F.when(F.col("side") == 1, F.col("value"))).alias("b"))
    q = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("frac"))
    return both.select(*keys, "j", "p", q.alias("q"), "n", "least", "greatest")


def part_sketches(df: DataFrame, cols, part: str, accuracy: int = ACCURACY) -> DataFrame:
    """(part, __g, n, least, greatest, kll): one mergeable sketch per part (a day, a file, a source) and column. Store it;
    a new part only adds its own rows (``part_sketches`` of the new rows, appended)."""
    return to_long(df, cols, part).groupBy(F.col("__by").alias("part"), "__g").agg(
        F.count(F.lit(1)).alias("n"), F.min("__v").alias("least"), F.max("__v").alias("greatest"),
        F.kll_sketch_agg_double("__v", _kll_k(accuracy)).alias("kll"))


def brackets_of(sketches: DataFrame, probs: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """The merged state of stored sketches as step 1 of ``quantile_table``: no row of the data is read."""
    merged = sketches.groupBy("__g").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
                                         F.kll_merge_agg_double("kll").alias("kll"))
    return merged.withColumn("s", _sketched(_grid(probs, rank_margin(accuracy)))).drop("kll")


def approx_from_sketches(sketches: DataFrame, probs: list[float]) -> DataFrame:
    """(column_name, p, q, n): quantiles of the merged sketches, within ``rank_margin`` of the rank."""
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    merged = sketches.groupBy("__g").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("kll").alias("kll"))
    both = merged.select("__g", "n", F.arrays_zip(wanted.alias("p"), F.kll_sketch_get_quantile_double("kll", wanted).alias("q")).alias("z"))
    return both.select(F.col("__g").alias("column_name"), "n", F.inline("z")).select("column_name", "p", "q", "n")


def _by_group(table: DataFrame, n_probs: int) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in table.select("__g", "j", "q").collect():
        out.setdefault(r["__g"], [None] * n_probs)[r["j"]] = r["q"]
    return out


def exact_quantiles(df: DataFrame, cols, probs: list[float], accuracy: int = ACCURACY) -> dict[str, list]:
    """Exact linear-interpolated quantiles of each column in ``cols`` (names, or a ``{name: Column}`` dict):
    ``{name: [q(p) for p in probs]}``, ``None`` for an input without values. A few numbers per column."""
    if not cols:
        return {}
    res = _by_group(quantile_table(to_long(df, cols), list(probs), accuracy=accuracy), len(probs))
    return {n: res.get(n, [None] * len(probs)) for n in _exprs(cols)}


def grouped_quantiles(long: DataFrame, probs: list[float], accuracy: int = ACCURACY) -> dict[str, list]:
    """``quantile_table`` of a (__g, __v) frame as a dict, for callers with a bounded number of groups."""
    long = long.select(F.col("__g").cast("string").alias("__g"), present(F.col("__v")).alias("__v")).where("__v IS NOT NULL")
    return _by_group(quantile_table(long, list(probs), accuracy=accuracy), len(probs))


def class_quantile_table(df: DataFrame, cols: list[str], by: str, probs: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles of each column in every class that the data has (NULL is a class): (column_name, by,
    n, least, greatest, q), q an array in the order of ``probs``. No list of classes, nothing collected."""
    t = quantile_table(to_long(df, cols, by), list(probs), ["__g", "__by"], accuracy)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("j", "q"))), lambda x: x["q"])
    return t.groupBy("__g", "__by").agg(F.first("n").alias("n"), F.first("least").alias("least"),
                                        F.first("greatest").alias("greatest"), ordered.alias("q")).select(
        F.col("__g").alias("column_name"), F.col("__by").alias(by), "n", "least", "greatest", "q")


def approx_quantiles(df: DataFrame, cols, probs: list[float],
                     accuracy: int = 10_000) -> dict[str, list]:
    """One-pass ``percentile_approx`` (rank error <= n / accuracy)."""
    ex = _exprs(cols)
    row = df.agg(*[F.percentile_approx(e, probs, accuracy).alias(f"c{i}")
                   for i, e in enumerate(ex.values())]).first()
    return {c: (list(row[f"c{i}"]) if row[f"c{i}"] is not None else [None] * len(probs))
            for i, c in enumerate(ex)}


def qcut_edges(df: DataFrame, cols: list[str], q: int = 5, method: str = "exact") -> dict[str, list]:
    """Unique quantile edges per column, like ``qcut(q, duplicates='drop')``.

    Returns ``{col: edges}``; ``[]`` when fewer than two distinct edges remain
    (a constant column has no bins)."""
    probs = [i / q for i in range(q + 1)]
    qs = (exact_quantiles if method == "exact" else approx_quantiles)(df, cols, probs)
    out = {}
    for c, vals in qs.items():
        edges: list[float] = []
        for v in vals:
            if v is not None and (not edges or v != edges[-1]):
                edges.append(float(v))
        out[c] = edges if len(edges) >= 2 else []
    return out


def bin_by_edges(x: Column, edges: list[float]) -> Column:
    """Right-closed bin index with the lowest edge included (S2):
    the number of inner edges strictly below ``x``; NULL stays NULL, and an
    empty edge list (constant column) gives NULL."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    expr = F.lit(0)
    for e in edges[1:-1]:
        expr = expr + (x > F.lit(e)).cast("int")
    return F.when(x.isNotNull(), expr)


def equal_width_edges(df: DataFrame, cols: list[str], bins: int = 5) -> dict[str, list]:
    """Equal-width edges over [min, max] (EN9); a constant column gets one bin."""
    row = df.agg(*[e for c in cols for e in (F.min(F.col(c).cast("double")).alias(f"lo_{c}"),
                                              F.max(F.col(c).cast("double")).alias(f"hi_{c}"))]).first()
    out = {}
    for c in cols:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        if lo is None:
            out[c] = []
        elif lo == hi:
            out[c] = [lo, hi + 1.0]
        else:
            out[c] = [lo + (hi - lo) * i / bins for i in range(bins + 1)]
    return out
