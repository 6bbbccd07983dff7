"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash that depends on nothing but its id, size and text. Words are summed by
source and hash bucket (the top ten bits); the bucket in which a source's budget ends is found
from the running sum of its at most 1,024 buckets, and only the documents of that one bucket go
to the next ten bits, until it holds a single hash value. The mix is then a filter
``hash < threshold``: no sort, and the same documents in every rerun. Larger budgets of a source
only raise its threshold, so mixes are nested. Where that last value is shared by repeated rows, they
are told apart by a second 60-bit key (the row's contents, then its place in the stored table), and the same
histograms find a threshold of it: rows that are equal throughout stand for one another.

A target above the source's size becomes whole repeats of the source plus a threshold for the
rest. The boundary document is taken if that brings the sum nearer to the budget.

Defined cases: NULL text has size 0; NULL is a source of its own, last in order; sources without
words have target 0; rows without an id hash by size and text; of repeated rows as many are taken as come nearest to the
target; an empty table gives no rows; other columns are ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import WORD, n_words, stored

BITS, LEVEL_BITS = 60, 10
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3


def mix_hash(size: str = "size", text: str = "text") -> Column:
    """60-bit hash of (doc_id, size, text), the same number in DuckDB (see ``ORACLE``)."""
    key = F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col(size).cast("string"),
                      F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def row_key(columns: list[str]) -> Column:
    """60-bit key that tells repeated rows apart: 30 bits of their contents, then 30 of their place."""
    contents = F.shiftrightunsigned(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))), 34)
    place = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 34)
    return F.shiftleft(contents, 30).bitwiseOR(place)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> target, whole repeats and rest. Weights go by source order, repeating.
    Targets above ``max_repeat`` sizes stop there and the excess goes to the others by weight; the
    fixed point of that is one level: a source is capped as long as its cap per weight is at most
    what remains per remaining weight. The windows run over one row per source."""
    everything = Window.partitionBy(F.lit(1))
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "weight").rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_repeat))
    s = s.withColumns({"budget": F.sum("source_size").over(everything) * F.lit(share),
                       "all_weight": F.sum("weight").over(everything),
                       "cap_before": F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0)),
                       "weight_before": F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0))})
    s = s.withColumn("capped", F.col("cap") * (F.col("all_weight") - F.col("weight_before"))
                     <= F.col("weight") * (F.col("budget") - F.col("cap_before")))
    level = ((F.col("budget") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything))
             / F.nullif(F.col("all_weight") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0.0)).over(everything),
                        F.lit(0.0)))
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.coalesce(F.col("weight") * level, F.lit(0.0))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return s.withColumn("whole", whole).select(
        "source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def boundaries(rows: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """One level: for each source of ``state`` (source, rest, below: words under the boundary bucket)
    the bucket of ``rows`` (source, k, size) in which the rest ends, and what it holds."""
    hist = rows.groupBy("source", F.shiftright("k", shift).alias("bucket")).agg(
        F.sum("size").alias("words"), F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    same = state.select(F.col("source").alias("s"), "rest", "below")
    run = (hist.withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
           .join(same, F.col("source").eqNullSafe(F.col("s")), "inner"))
    over = run.filter(F.col("below") + F.col("before") + F.col("words") > F.col("rest"))
    first = F.min_by(F.struct("bucket", (F.col("below") + F.col("before")).alias("below"), "words", "low", "high", "n"), "bucket")
    return over.groupBy("source", "rest").agg(first.alias("b")).select("source", "rest", "b.*")


def refine(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Per source of ``state`` (source, rest, below) the single key of ``rows`` (source, k, size) in which the rest
    ends: low, cut (the key below which rows are taken), words and n, the rows that have it."""
    shift, done = BITS - LEVEL_BITS, None
    while True:
        found = stored(boundaries(rows, state, shift), "mix-boundary")
        single = found.filter(F.col("low") == F.col("high"))
        done = single if done is None else done.unionByName(single)
        state = found.filter(F.col("low") < F.col("high"))
        if shift == 0 or state.isEmpty():
            break
        edge = state.select(F.col("source").alias("s"), "bucket")
        rows = stored(rows.join(edge, F.col("source").eqNullSafe(F.col("s"))
                                & (F.shiftright("k", shift) == F.col("bucket")), "left_semi"), "mix-bucket")
        shift -= LEVEL_BITS
    nearer = F.col("below") + F.col("words") - F.col("rest") < F.col("rest") - F.col("below")
    return done.withColumn("cut", F.col("low") + F.when(nearer, 1).otherwise(0))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source h_cut and u_cut: a document of ``sized`` (source, h, u, size) is taken once more if
    h < h_cut, or h = h_cut and u < u_cut."""
    state = targets.filter(F.col("rest") > 0).select("source", "rest", F.lit(0).cast("long").alias("below"))
    first = refine(sized.select("source", F.col("h").alias("k"), "size"), state)
    alone = first.filter("n = 1").select("source", F.col("cut").alias("h_cut"), F.lit(0).cast("long").alias("u_cut"))
    tied = first.filter("n > 1").select("source", "rest", "below", "low")
    if tied.isEmpty():
        return alone
    edge = tied.select(F.col("source").alias("s"), "low")
    repeats = stored(sized.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("h") == F.col("low")), "inner")
                     .select("source", F.col("u").alias("k"), "size"), "mix-repeats")
    second = refine(repeats, tied.drop("low")).select(F.col("source").alias("s"), F.col("cut").alias("u_cut"))
    return alone.unionByName(tied.join(second, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", F.col("low").alias("h_cut"), "u_cut"))


def mix(df: DataFrame, weights=WEIGHTS, share: float = 1.0, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, source, size, source_size, target, whole, h_cut, copies and taken, a row per document."""
    sized = df.select("doc_id", "source", n_words(F.col("text")).alias("size"), "text").withColumn("h", mix_hash())
    sized = stored(sized.select("doc_id", "source", "size", "h", row_key(["doc_id", "h"]).alias("u")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, max_repeat), "mix-targets")
    cuts = thresholds(sized.select("source", "h", "u", "size"), targets)
    a, b = targets.alias("a"), cuts.select(F.col("source").alias("cs"), "h_cut", "u_cut").alias("b")
    plan = stored(a.join(b, F.col("source").eqNullSafe(F.col("cs")), "left").select(
        F.col("source").alias("ps"), "source_size", "target", "whole",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("h_cut", "u_cut")]), "mix-plan")
    again = (F.col("h") < F.col("h_cut")) | ((F.col("h") == F.col("h_cut")) & (F.col("u") < F.col("u_cut")))
    copies = F.col("whole") + F.when(again, 1).otherwise(0)
    return (sized.join(plan, F.col("source").eqNullSafe(F.col("ps")))
            .withColumn("copies", copies.cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
            .drop("ps"))


def apply_mix(df: DataFrame, weights=WEIGHTS, share: float = 1.0, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixed table: every document of ``df`` as often as the mix takes it, all columns kept.
    Hash and size are recomputed in the same scan, so no join on document ids is needed; only repeated rows
    at a source's threshold are stored and counted off."""
    plan = mix_plan(df, weights, share, max_repeat)
    names = df.columns
    # private names, so that columns called size or h are kept
    key = df.select(*names, n_words(F.col("text")).alias("__size"))
    key = key.withColumn("__h", mix_hash("__size")).join(plan, F.col("source").eqNullSafe(F.col("__source")), "left")
    again = F.when(F.col("__h") < F.col("__h_cut"), 1).otherwise(0)
    if not plan.filter("__ties > 0").isEmpty():
        at_cut = (F.col("__ties") > 0) & (F.col("__h") == F.col("__h_cut"))
        repeats = stored(key.filter(at_cut).withColumn("__u", row_key(names)), "mix-tied")
        state = plan.filter("__ties > 0").select(F.col("__source").alias("source"), F.col("__ties").cast("double").alias("rest"),
                                                 F.lit(0).cast("long").alias("below"))
        ends = refine(repeats.select("source", F.col("__u").alias("k"), F.lit(1).cast("long").alias("size")), state)
        ends = ends.select(F.col("source").alias("__s"), F.col("cut").alias("__cut"))
        # every row of a source is taken where no end is found
        repeats = repeats.join(ends, F.col("source").eqNullSafe(F.col("__s")), "left").withColumn(
            "__again", F.when(F.coalesce(F.col("__u") < F.col("__cut"), F.lit(True)), 1).otherwise(0))
        key = key.filter(~F.coalesce(at_cut, F.lit(False))).withColumn("__again", again)
        key = key.unionByName(repeats.select(*key.columns))
        again = F.col("__again")
    copies = (F.col("__whole") + again).cast("int")
    return (key.filter(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).select(*names))


def mix_plan(df: DataFrame, weights=WEIGHTS, share: float = 1.0, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """__source, __whole, __h_cut and __ties (repeated rows at h_cut that are taken once more), stored: one
    row per source."""
    tie = F.when((F.col("h") == F.col("h_cut")) & (F.col("u") < F.col("u_cut")), 1).otherwise(0)
    plan = mix(df, weights, share, max_repeat).groupBy("source").agg(
        F.first("whole").alias("__whole"), F.first("h_cut").alias("__h_cut"), F.sum(tie).alias("__ties"))
    return stored(plan.withColumnRenamed("source", "__source"), "mix-taken")


# the definition in SQL: running sums over each source's documents in hash order
ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, coalesce(text, '') AS text FROM documents),
k0 AS (SELECT doc_id, source, size, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '-') || ':' || size::VARCHAR || ':' || md5(text)), 1, 15))::BIGINT AS h
       FROM d),
h AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS nth FROM k0),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight
      FROM h GROUP BY source),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS budget, sum(weight) OVER () AS all_weight FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before FROM c
      WINDOW w AS (ORDER BY cap / weight, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, cap * (all_weight - weight_before) <= weight * (budget - cap_before) AS capped FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE coalesce(weight * ((budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
      / nullif(all_weight - sum(CASE WHEN capped THEN weight ELSE 0 END) OVER (), 0)), 0) END AS target FROM k),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
x AS (SELECT h.doc_id, h.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
      sum(h.size) OVER (PARTITION BY h.source ORDER BY h.h, h.nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto <= rest OR (upto - size <= rest AND upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x"""
