"""Scalar column functions (PR4-PR15, FN1-FN6): built-in expressions only,
so they stay inside whole-stage codegen and also work on streaming frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the epsilon added to denominators by the reference's ratios.
EPS = 1e-8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def binary_target(col, positive) -> Column:
    """PR4: 1 when equal to ``positive`` else 0 (NULL gives 0)."""
    return F.when(_c(col) == F.lit(positive), 1).otherwise(0)


def threshold_flag(col, threshold, op: str = ">=") -> Column:
    """PR5 / PR14: (col >= t) or (col < t) as int; NULL stays NULL."""
    c = _c(col)
    cond = {">=": c >= threshold, ">": c > threshold, "<": c < threshold, "<=": c <= threshold}[op]
    return cond.cast("int")


def ordinal_encode(col, mapping: dict) -> Column:
    """PR6: dictionary encoding; unmapped values (and NULL) give NULL (S21, S24)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, _c(col))


def period_start(col, sep: str = "-") -> Column:
    """FN1 / FN2: first year of a 'YYYY-YYYY' period (try_cast: bad text gives NULL)."""
    return F.split_part(_c(col), F.lit(sep), F.lit(1)).try_cast("int")


def period_end(col, sep: str = "-") -> Column:
    return F.split_part(_c(col), F.lit(sep), F.lit(2)).try_cast("int")


def safe_ratio(a, b, eps: float = EPS) -> Column:
    """FN5: a / (b + eps)."""
    return _c(a) / (_c(b) + F.lit(eps))


def bare_ratio(a, b) -> Column:
    """FN5 / S9: a / b with division by zero giving NULL (ANSI-safe)."""
    return F.try_divide(_c(a), _c(b))


def clip(col, lo=None, hi=None) -> Column:
    """FN6 / S8: clip to [lo, hi]; NULL stays NULL (greatest/least would not)."""
    c = _c(col)
    out = c
    if lo is not None:
        out = F.when(c < _lit(lo), _lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(c > _lit(hi), _lit(hi)).otherwise(out)
    return out


def _lit(v):
    return v if isinstance(v, Column) else F.lit(v)


def round_half_even(col, digits: int) -> Column:
    """PR15 / S5: numpy's rounding, rint(x * 10^d) / 10^d (half-even on the
    binary value). ``bround`` rounds the shortest decimal string instead and
    differs on values like 2469.885."""
    scale = F.lit(float(10 ** digits))
    return F.rint(_c(col).cast("double") * scale) / scale


def safe_log(col) -> Column:
    """FN4: natural log, NULL for x <= 0 (S9)."""
    c = _c(col)
    return F.when(c > 0, F.ln(c))


def safe_log10(col) -> Column:
    c = _c(col)
    return F.when(c > 0, F.log10(c))


def safe_log2(col) -> Column:
    c = _c(col)
    return F.when(c > 0, F.log2(c))


def safe_log1p(col) -> Column:
    c = _c(col)
    return F.when(c > -1, F.log1p(c))


def masked_update(col, mask: Column, value) -> Column:
    """PR10: df.loc[mask, c] = v as an expression."""
    return F.when(mask, _lit(value)).otherwise(_c(col))


def all_present(cols: list[str]) -> Column:
    """PR9: every listed column is non-NULL."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def display_names(col, names: dict) -> Column:
    """FN8: column-name -> display-name lookup (a literal map); unknown names
    pass through unchanged."""
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, _c(col)), _c(col))
