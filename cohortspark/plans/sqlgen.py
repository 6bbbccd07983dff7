"""Helpers that write DuckDB oracle SQL for the repeated shapes (binning,
unpivot, entropy). They only build strings; DuckDB runs them independently of
Spark, so a shared helper cannot hide a Spark-side bug."""

from __future__ import annotations


def qcut_bins_sql(src: str, cols: list[str], q: int, keep: list[str]) -> str:
    """SELECT keep..., <col> AS bin-of-col for right-closed quantile bins."""
    probs = ", ".join(str(i / q) for i in range(1, q))
    stats = ", ".join(
        f"quantile_cont({c}, [{probs}]) AS q_{c}, min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in cols)
    inner = ", ".join(
        f"list_filter(list_distinct(q_{c}), lambda v: v > mn_{c} AND v < mx_{c}) AS e_{c}, mn_{c}, mx_{c}"
        for c in cols)
    bins = ", ".join(
        f"CASE WHEN s.{c} IS NULL OR mn_{c} = mx_{c} THEN NULL "
        f"ELSE len(list_filter(e_{c}, lambda v: v < s.{c})) END AS {c}" for c in cols)
    keep_s = "".join(f"s.{k}, " for k in keep)
    return (f"SELECT {keep_s}{bins} FROM ({src}) s, "
            f"(SELECT {inner} FROM (SELECT {stats} FROM ({src}) z) z2) e")


def width_bins_sql(src: str, cols: list[str], bins: int, keep: list[str]) -> str:
    stats = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in cols)
    exprs = []
    for c in cols:
        terms = " + ".join(
            f"(s.{c} > mn_{c} + (mx_{c} - mn_{c}) * {i} / {bins})::INTEGER" for i in range(1, bins))
        exprs.append(f"CASE WHEN s.{c} IS NULL THEN NULL WHEN mn_{c} = mx_{c} THEN 0 ELSE {terms} END AS {c}")
    keep_s = "".join(f"s.{k}, " for k in keep)
    return f"SELECT {keep_s}{', '.join(exprs)} FROM ({src}) s, (SELECT {stats} FROM ({src}) z) e"


def unpivot_sql(src: str, cols: list[str], keep: list[str], name: str = "feature",
                value: str = "bin", cast: str = "VARCHAR") -> str:
    keep_s = "".join(f"{k}, " for k in keep)
    return " UNION ALL ".join(
        f"SELECT {keep_s}'{c}' AS {name}, CAST({c} AS {cast}) AS {value} FROM ({src}) u" for c in cols)


def ig_sql(long_src: str, target: str, types: dict[str, str], null_policy: str = "drop",
           digits: int = 6) -> str:
    """Information gain from a long (feature, bin, target) relation, written
    with textbook -sum(p log2 p) sums."""
    tmap = " ".join(f"WHEN '{f}' THEN '{ty}'" for f, ty in types.items())
    if null_policy == "drop":
        base_rows, denom_rows = "bin IS NOT NULL", "bin IS NOT NULL"
    elif null_policy == "reference":
        base_rows, denom_rows = "TRUE", "TRUE"
    else:  # target_all
        base_rows, denom_rows = "TRUE", "bin IS NOT NULL"
    return f"""
WITH l AS ({long_src}),
cnt AS (SELECT feature, bin, {target} AS y, count(*) AS c FROM l GROUP BY ALL),
nall AS (SELECT feature, sum(c) AS n FROM cnt GROUP BY ALL),
nb_rows AS (SELECT feature, sum(c) AS n FROM cnt WHERE {base_rows} GROUP BY ALL),
nd_rows AS (SELECT feature, sum(c) AS n FROM cnt WHERE {denom_rows} GROUP BY ALL),
hy_all AS (SELECT k.feature, -sum((k.c / a.n) * log2(k.c / a.n)) AS h
           FROM (SELECT feature, y, sum(c) AS c FROM cnt GROUP BY ALL) k JOIN nall a USING (feature) GROUP BY ALL),
hy AS (SELECT k.feature, -sum((k.c / a.n) * log2(k.c / a.n)) AS h
       FROM (SELECT feature, y, sum(c) AS c FROM cnt WHERE {base_rows} GROUP BY ALL) k
       JOIN nb_rows a USING (feature) GROUP BY ALL),
hb AS (SELECT k.feature, k.bin, -sum((k.c / b.nb) * log2(k.c / b.nb)) AS h, any_value(b.nb) AS nb
       FROM cnt k JOIN (SELECT feature, bin, sum(c) AS nb FROM cnt WHERE bin IS NOT NULL GROUP BY ALL) b
       USING (feature, bin) GROUP BY ALL),
hc AS (SELECT hb.feature, sum(hb.nb / d.n * hb.h) AS h FROM hb JOIN nd_rows d USING (feature) GROUP BY ALL),
g AS (SELECT a.feature, coalesce(hy.h - coalesce(hc.h, 0), 0) AS gain, ha.h AS base
      FROM nall a JOIN hy_all ha USING (feature) LEFT JOIN hy USING (feature) LEFT JOIN hc USING (feature))
SELECT feature, CASE feature {tmap} END AS feature_type,
       round_even(gain, {digits}) AS information_gain,
       round_even(CASE WHEN base > 0 THEN gain / base * 100 ELSE 0 END, {digits}) AS pct_base_entropy,
       CAST(row_number() OVER (ORDER BY gain DESC, feature) AS INTEGER) AS rank
FROM g"""
