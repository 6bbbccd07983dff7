"""Corpus pipeline over ``documents``: toxicity, near-duplicates, secrets, source mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but
the last return the columns of their input. ``run`` stores each stage's result in the shared folder,
so a stage never repeats an earlier one. SQL cannot express the classifier, the signatures or the
tokenizer; ``tests/llm/test_pipeline.py`` holds each stage against brute force.
"""

from __future__ import annotations

from cohortspark.llm import dart_minhash, mixing, packing, secret_scan, toxicity
from cohortspark.llm.common import stored, table


def drop_toxic(spark, docs, sf_dir):
    """Toxicity: a classifier learned from the labelled documents removes what it scores 0.7 or more."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_duplicates(spark, docs, sf_dir):
    """MinHash near-dedup: of each class of near-duplicates the document with the smallest id stays."""
    return dart_minhash.keep_one(docs)


def mask_secrets(spark, docs, sf_dir):
    """Secret scans: found secrets are masked in the text; all documents stay."""
    return secret_scan.redact_secrets(docs)


def mix_sources(spark, docs, sf_dir):
    """Mixing sources to target weights: every document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def pack_sequences(spark, docs, sf_dir):
    """Packing: the pieces of all documents in sequences of at most 1,024 ids."""
    return packing.pack(docs, memo=400_000)      # the executors have four stages behind them


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_duplicates),
    ("secret scans", mask_secrets),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
