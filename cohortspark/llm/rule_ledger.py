"""Quality rules as a bitmask ledger.

``measure`` reads every text once, ``ledger`` evaluates every rule once over the measurements and keeps
the failures as bits of one long, and ``store_ledger`` writes both as a table, with the fingerprint of the rules it
was made by. Everything later reads that table and no text: a policy is a versioned bit mask,
``verdict`` applies it with one bitwise AND, and ``ablation`` counts, in a single aggregation,
what each rule rejects, rejects alone, and would let through if it were left out.

Defined cases: a NULL text has no words and fails ``few_words``; a text without words has every
measurement 0; repeated rows are judged alike; an empty table gives an empty ledger and zero
counts; a text of any length is measured whole.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import groups_of, map_batches, mix64, text_bytes

SYMBOLS = b"#*$%&|<>"
WINDOW = 5

# rule name -> failure condition over the measurements; the bit is the position in this table
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbol_share": "20 * n_symbols > word_chars",
    "duplicate_lines": "10 * n_dup_lines > 4 * n_lines",
    "stuttered_words": "10 * n_stutter > 3 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "no_letters": "n_words > 0 AND 2 * n_letter_words < n_words",
}
BASE_RULES = ["few_words", "repeated_windows"]
# versioned policies: the rules whose failure rejects a document
POLICIES: dict[str, list[str]] = {
    "base": BASE_RULES,
    "v1": [*BASE_RULES, "symbol_share", "duplicate_lines"],
    "v2": [*BASE_RULES, "symbol_share", "duplicate_lines", "stuttered_words", "long_words", "short_words", "no_letters"],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter", "n_letter_words"]
_DIGITS_PUNCT = bytes(range(0x21, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))


def repeats(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the number of its words inside a window of five words that occurs twice or
    more in that text, and of its words equal to the word before. Words are numbered exactly; windows
    are compared by a 64-bit hash."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = [w for ws in words for w in ws]
    doc = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
    codes = pd.factorize(np.array(flat, dtype=object))[0].astype(np.uint64)
    stutter = np.bincount(doc[1:][(codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])], minlength=len(words))
    if len(flat) < WINDOW:
        return np.zeros(len(words), dtype=np.int64), stutter
    h = mix64(doc[:len(flat) - WINDOW + 1].astype(np.uint64) + np.uint64(1))
    for j in range(WINDOW):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + codes[j:len(flat) - WINDOW + 1 + j] + np.uint64(1))
    inside = doc[:len(h)] == doc[WINDOW - 1:]
    at = np.flatnonzero(inside)
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(flat), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    for j in range(1, WINDOW):
        covered[j:] |= twice[:-j]
    return np.bincount(doc[covered], minlength=len(words)), stutter


def text_measures(texts: list[bytes]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {m: [] for m in MEASURES}
    for lo, hi in groups_of(texts, 1 << 19):
        words = [b.split() for b in texts[lo:hi]]
        repeated, stutter = repeats(words)
        out["n_repeat_words"] += repeated.tolist()
        out["n_stutter"] += stutter.tolist()
        for raw, ws in zip(texts[lo:hi], words):
            solid = b"".join(ws)
            lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
            out["n_words"].append(len(ws))
            out["word_chars"].append(len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace")))
            out["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
            out["n_lines"].append(len(lines))
            out["n_dup_lines"].append(len(lines) - len(set(lines)))
            out["n_letter_words"].append(len(raw.translate(None, _DIGITS_PUNCT).split()))
    return out


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the measurements over its whole text."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = text_measures(text_bytes(batch["text"]))
        return pa.RecordBatch.from_arrays(
            [batch["id"], *(pa.array(got[m], pa.int64()) for m in MEASURES)], ["id", *MEASURES])

    src = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    kind = src.schema["id"].dataType.simpleString()
    out = map_batches(src, run, f"id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return out.withColumnRenamed("id", id_col)


def bits(rules: list[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def ledger(measured: DataFrame) -> DataFrame:
    """``measured`` with ``fail_bits``: bit i is set if rule i fails. Every rule is evaluated once."""
    total: Column = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        total = total.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", total)


def rules_fingerprint() -> str:
    """SHA-256 of the rules, in order: bits of a ledger mean something only under the rules that set them."""
    return hashlib.sha256(json.dumps(list(RULES.items())).encode()).hexdigest()


def store_ledger(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measure and judge every document once and write the ledger to ``path``; returns ``open_ledger`` of it."""
    led = ledger(measure(df, id_col, text_col)).withColumn("rules", F.lit(rules_fingerprint()))
    led.write.parquet(path)
    return open_ledger(df.sparkSession, path)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A stored ledger; refused if it was made by other rules."""
    led = spark.read.parquet(path)
    other = led.filter(F.col("rules") != rules_fingerprint()).select("rules").limit(1).collect()
    if other:
        raise ValueError("the ledger was made by other rules")
    return led.drop("rules")


def fails(policy: str, column: str = "fail_bits") -> Column:
    """True where the ledger bits break the named policy."""
    return F.col(column).bitwiseAND(F.lit(bits(POLICIES[policy])).cast("long")) != 0


def verdict(led: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy version."""
    return led.withColumns({"base_failed": fails("base"), "kept": ~fails("base") & ~fails(policy)})


def with_ablation(led: DataFrame, policy: str = "v2") -> DataFrame:
    """The verdict under a policy, and for documents that a single rule rejects that rule (``lone_rule``) and the number of
    documents that would come back without it (``returns_without``), from one ablation over the same ledger."""
    returns = {r["rule"]: r["rejects_alone"] for r in ablation(led, policy).collect()}     # a row per rule
    hit = F.col("fail_bits").bitwiseAND(F.lit(bits(POLICIES[policy])).cast("long"))
    lone, count = F.lit(None).cast("string"), F.lit(None).cast("long")
    for rule, n in returns.items():
        lone = F.when(hit == bits([rule]), F.lit(rule)).otherwise(lone)
        count = F.when(hit == bits([rule]), F.lit(n).cast("long")).otherwise(count)
    return verdict(led, policy).withColumns({"lone_rule": lone, "returns_without": count})


def ablation(led: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of the policy: documents it rejects, those it alone rejects (they would come
    back without it) and what the policy keeps with and without it. One aggregation over the bits."""
    mask, names = bits(POLICIES[policy]), POLICIES[policy]
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    one = [F.count_if(hit.bitwiseAND(F.lit(bits([r])).cast("long")) != 0).alias(f"r{i}") for i, r in enumerate(names)]
    alone = [F.count_if(hit == bits([r])).alias(f"a{i}") for i, r in enumerate(names)]
    sums = led.agg(F.count_if(hit == 0).alias("kept"), *one, *alone)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").alias("rejects"), F.col(f"a{i}").alias("rejects_alone"),
                              F.col("kept"), (F.col("kept") + F.col(f"a{i}")).alias("kept_without"))
                     for i, r in enumerate(names)])
    return sums.select(F.inline(rows))
