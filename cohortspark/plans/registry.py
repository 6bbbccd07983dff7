"""Query registry: name -> (spark builder, DuckDB oracle SQL or None, ids)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Registered:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str


REGISTRY: dict[str, Registered] = {}


def _bigint_count_if(sql: str) -> str:
    """DuckDB's count_if returns HUGEINT; Spark's count_if returns BIGINT.
    Wrap every count_if(...) call in CAST(... AS BIGINT)."""
    out, i, tok = [], 0, "count_if("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(tok)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = _bigint_count_if(sql[j + len(tok):k - 1])
        out.append(sql[i:j] + f"CAST(count_if({inner}) AS BIGINT)")
        i = k


def register(name: str, ids: str, sql: str | None = None):
    """Decorator: register a (spark, sf_dir) -> DataFrame builder."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Registered(name, fn, _bigint_count_if(sql) if sql else None, ids)
        return fn
    return deco


def load_all() -> dict[str, Registered]:
    # importing the topic modules fills REGISTRY
    from cohortspark.plans import (  # noqa: F401
        q_audit, q_cluster, q_entropy, q_impute, q_metrics, q_models, q_prep, q_profile, q_search,
    )
    return REGISTRY
