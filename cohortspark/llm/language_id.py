"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and every run of characters that are no letters becomes one word border.
Features are the n-grams of 1 to 4 characters that lie in one word, its borders included, hashed
into 2^16 buckets. Training counts buckets per language over all given documents, in one scan with
one count vector per task and language, and sums the vectors by (language, bucket). The matrix of
smoothed log probabilities (buckets x languages, at most ``MAX_LANGS`` languages) is broadcast.
Scoring turns each Arrow batch into a sparse row structure (bucket ids of all n-grams in document
order and the offset of each document), gathers the matrix rows and adds them up by document.

The score is the posterior probability of the predicted language; ties go to the first language in
code point order. Only the text enters a prediction. Long texts are read whole, in slices of at most
2^18 characters cut at spaces; a longer run without a space counts as several words.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0; so is every text if no
document has a language; NULL languages are not learned from; one language alone is always
predicted; repeated rows count each time in training and are predicted alike; an empty table gives no
rows; ``predict`` keeps all columns and puts its own two behind them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortspark.llm.common import groups_of, stored, text_bytes

BUCKET_BITS = 16
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
MAX_LANGS = 256
SLICE = 1 << 18
UNKNOWN = "und"
MULTIPLIER = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    log_probs: np.ndarray      # buckets x languages
    log_priors: np.ndarray


@cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def slices(text: str) -> Iterator[str]:
    """The text in pieces of at most ``SLICE`` characters, cut behind a space or line end if there is one."""
    lo = 0
    while len(text) - lo > SLICE:
        at = max(text.rfind(" ", lo, lo + SLICE), text.rfind("\n", lo, lo + SLICE))
        hi = at + 1 if at >= lo else lo + SLICE
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: the bucket of every n-gram of all texts, in order, and the offset of each text's
    first one (one offset more than texts)."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("\0".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = letter_table()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]          # one border after each word
    kept[0] = True                   # and one before the first
    c = np.where(letter, points, 0).astype(np.uint32)[kept]
    letter = letter[kept]
    places = np.cumsum(kept) - kept
    # text k begins behind k + 1 separators; a border belongs to the word before it
    starts = places[np.concatenate([[0], np.cumsum(sizes + 1)]) + 1 - (np.arange(len(sizes) + 1) == len(sizes))]
    starts[-1] = len(c)
    h = c * MULTIPLIER
    for n in ORDERS:
        if n == 1:
            valid, at = np.flatnonzero(letter), 0
        else:
            if len(c) < n:
                yield np.empty(0, np.int64), np.zeros(len(sizes) + 1, np.int64)
                continue
            h = (h[:-1] + c[n - 1:]) * MULTIPLIER
            inner = np.ones(len(h), dtype=bool) if n > 2 else letter[:-1] | letter[1:]
            for j in range(1, n - 1):
                inner &= letter[j:j + len(h)]
            valid, at = np.flatnonzero(inner), 1
        yield (h[valid] >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), np.searchsorted(valid + at, starts)


def batches_of(column: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """Slices of consecutive texts of a column, with the row each slice belongs to."""
    raw = text_bytes(column)
    for lo, hi in groups_of(raw, 1 << 20):
        rows, parts = [], []
        for i in range(lo, hi):
            for part in slices(raw[i].decode("utf-8", "replace")):
                rows.append(i)
                parts.append(part)
                if len(parts) >= 4096 or len(part) == SLICE:
                    yield rows, parts
                    rows, parts = [], []
        if rows:
            yield rows, parts


def count_ngrams(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, bucket, n) over all documents with a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for rows, parts in batches_of(batch["text"]):
                names = sorted({langs[r] for r in rows})
                code = np.array([names.index(langs[r]) for r in rows])
                for bucket, offsets in ngrams(parts):
                    of = np.repeat(code, np.diff(offsets))
                    tally = np.bincount((of << BUCKET_BITS) | bucket, minlength=len(names) << BUCKET_BITS)
                    for i, name in enumerate(names):
                        counts.setdefault(name, np.zeros(1 << BUCKET_BITS, np.int64))
                        counts[name] += tally[i << BUCKET_BITS:(i + 1) << BUCKET_BITS]
        for name, tally in counts.items():
            at = np.flatnonzero(tally)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(tally[at])],
                                             ["lang", "bucket", "n"])

    src = docs.filter(F.col(lang_col).isNotNull()).selectExpr(f"`{lang_col}` AS lang", f"`{text_col}` AS text")
    return src.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", smoothing: float = SMOOTHING) -> Model:
    """The model of all rows of ``docs`` with a language."""
    sizes = docs.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count().limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    by_lang = {r.lang: r["count"] for r in sizes}
    langs = sorted(by_lang)
    counts = np.zeros((1 << BUCKET_BITS, len(langs)))
    if langs:
        got = stored(count_ngrams(docs, lang_col, text_col), "language-counts").toArrow()   # at most buckets x languages rows
        code = np.array([langs.index(x) for x in got["lang"].to_pylist()], dtype=np.int64)
        counts[got["bucket"].to_numpy(), code] = got["n"].to_numpy()
    total = counts.sum(axis=0) + smoothing * len(counts)
    n = np.array([by_lang[x] for x in langs], dtype=float)
    return Model(tuple(langs), np.log((counts + smoothing) / total), np.log(n / n.sum()) if langs else n)


def score_texts(rows: list[int], parts: list[str], log_probs: np.ndarray, scores: np.ndarray, seen: np.ndarray) -> None:
    """Add the log probabilities of all n-grams of each part to its row of ``scores``; mark rows with letters."""
    for bucket, offsets in ngrams(parts):
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            sums = np.add.reduceat(log_probs[bucket], offsets[:-1][full], axis=0)
            at = np.asarray(rows)[full]
            np.add.at(scores, at, sums)
            seen[at] = True


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred and score."""
    spark, langs = df.sparkSession, model.langs
    matrix = spark.sparkContext.broadcast((model.log_probs, model.log_priors))
    text_at, fields = df.columns.index(text_col), df.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_probs, log_priors = matrix.value
        for batch in batches:
            size = batch.num_rows
            scores, seen = np.tile(log_priors, (size, 1)), np.zeros(size, dtype=bool)
            if langs:
                for rows, parts in batches_of(batch.column(text_at)):
                    score_texts(rows, parts, log_probs, scores, seen)
            if not langs:
                best, share = [UNKNOWN] * size, np.zeros(size)
            else:
                top = scores.argmax(axis=1)
                share = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
                best, share = [langs[j] if s else UNKNOWN for j, s in zip(top, seen)], np.where(seen, share, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(share, pa.float64())],
                                             [*batch.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, StructType([*fields, *StructType.fromDDL("lang_pred string, score double").fields]))
