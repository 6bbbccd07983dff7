"""Toxicity: a counterfactually regularised logistic classifier over word and word-start counts.

Training uses a bounded sample of labelled documents (``sample_per_class`` of each class, chosen
by hash, weighted back to the class shares). Candidate features are whole lower-cased words and
word starts of 4 to 8 letters; the ``n_features`` most associated with the label (chi-square over
the sample) are kept, each with two values: its capped count and its capped share of the words.

Counterfactual regularisation: every labelled text that mentions identity terms is compared with its
swapped copies, one per group it mentions and other member of that group: the group's terms move on by
1, 2, ... places around the group, so each member meets every other one, and a word of two groups
moves in each. The penalty is the mean over those texts of the mean squared change of the log-odds (the score
before the logistic function) between text and copies, so the score does not depend on which group
is named. Terms seen in the sample are always features, so that their weights are under that penalty.
The changes reach the driver as sparse rows (at most ``MAX_COPIES`` a text) and stay there as one
features x features sum of products.

Scoring is one pass over all documents with the few hundred fitted weights; neither labels nor
lang, source or ids enter a score.

Defined cases: NULL and empty texts score the intercept alone; NULL labels or ids are not
learned from; of repeated labels the highest counts, of documents that share an id the greatest text (scored are all
of them); with no labelled document of a class every
score is the smoothed class share; an empty table gives no rows; long texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import map_batches, stored, text_bytes

SAMPLE_PER_CLASS = 6000
N_FEATURES = 512
STARTS = range(4, 9)
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
HASH_SPACE = 1 << 32
HELD = 200_000

# fixed values: identity terms, interchangeable within a group
IDENTITY_GROUPS = [
    ["women", "men", "girls", "boys"], ["woman", "man", "girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"],
    ["black", "white", "asian", "latino", "african", "european", "american", "arab"],
    ["gay", "lesbian", "bisexual", "transgender", "straight", "heterosexual", "homosexual", "queer"],
    ["immigrants", "refugees", "foreigners", "natives"], ["blind", "deaf", "disabled", "paralyzed"],
    ["young", "old", "elderly"],
    ["femmes", "hommes", "filles", "garçons"], ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"],
    ["immigrés", "réfugiés", "étrangers"],
    ["frauen", "männer", "mädchen", "jungen"], ["muslime", "christen", "juden", "hindus", "buddhisten"],
    ["einwanderer", "flüchtlinge", "ausländer"],
    ["mujeres", "hombres", "chicas", "chicos"], ["musulmanes", "cristianos", "judíos", "hindúes", "budistas"],
    ["inmigrantes", "refugiados", "extranjeros"],
]
PLACES: dict[str, list[tuple[int, int]]] = {}      # term -> (group, place) of every group that has it
for _g, _group in enumerate(IDENTITY_GROUPS):
    for _i, _w in enumerate(_group):
        PLACES.setdefault(_w, []).append((_g, _i))
MAX_COPIES = sum(len(g) - 1 for g in IDENTITY_GROUPS)


@dataclass(frozen=True)
class Model:
    features: dict[str, int]
    count_weights: tuple[float, ...]
    share_weights: tuple[float, ...]
    intercept: float


def words_of(raw: bytes) -> list[str]:
    return LETTERS.findall(raw.decode("utf-8", "replace").lower())


def starts(word: str) -> list[str]:
    """Features of a word: itself and its starts (marked with a trailing ``*``)."""
    return [word] + [word[:n] + "*" for n in STARTS if len(word) > n]


def values(counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(counts, 4) / 4, np.minimum(1, 25 * counts / np.maximum(n, 1))


def in_training(doc_id: Column) -> Column:
    """Rows that labels may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_per_class: int) -> DataFrame:
    """text, label, weight of the bounded training sample, stored."""
    lab = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & in_training(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")))
    sizes = {r.label: r.n for r in lab.filter(F.col("label").isin(0, 1)).groupBy("label").agg(F.count("*").alias("n")).collect()}
    kept = {y: min(1.0, sample_per_class / n) for y, n in sizes.items()}
    h = F.crc32(F.concat(F.lit("toxicity:"), F.col("doc_id").cast("string")))
    chosen = F.lit(False)
    weight = F.lit(0.0)
    for y, part in kept.items():
        chosen = chosen | ((F.col("label") == y) & (h < F.lit(int(part * HASH_SPACE))))
        weight = F.when(F.col("label") == y, F.lit(1 / part)).otherwise(weight)
    picked = stored(lab.filter(chosen).select(F.col("doc_id").alias("id"), "label", weight.alias("weight")), "toxic-sample")
    rows = picked.count()      # one row per id
    if rows > 2 * (2 * sample_per_class + 1000):
        raise ValueError(f"the sample of {rows} labelled rows exceeds its bound")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(picked), "id")
    return stored(texts.groupBy("id", "label", "weight").agg(F.max("text").alias("text")), "toxic-texts")


def select_features(sample: DataFrame, n_features: int) -> list[str]:
    """The features with the highest chi-square over the sample's class-weighted document counts."""
    def flushed(pos: Counter, neg: Counter) -> pa.RecordBatch:
        keys = list(pos.keys() | neg.keys())
        return pa.RecordBatch.from_pydict({"feature": pa.array(keys, pa.string()), "pos": pa.array([pos[k] for k in keys], pa.int64()),
                                           "neg": pa.array([neg[k] for k in keys], pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the documents that have a feature, handed on whenever ``HELD`` features are held."""
        pos, neg = Counter(), Counter()
        for batch in batches:
            for raw, y in zip(text_bytes(batch["text"]), batch["label"].to_pylist()):
                (pos if y else neg).update({f for w in set(words_of(raw)) for f in starts(w)})
                if len(pos) + len(neg) > HELD:
                    yield flushed(pos, neg)
                    pos, neg = Counter(), Counter()
        yield flushed(pos, neg)

    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(n.get(1, 0)), float(n.get(0, 0))
    if not n1 or not n0:
        return []
    tallied = sample.select("text", "label").mapInArrow(count, "feature string, pos bigint, neg bigint").groupBy("feature").agg(
        F.sum("pos").cast("double").alias("a"), F.sum("neg").cast("double").alias("b"))
    total = n1 + n0
    seen = F.col("a") + F.col("b")
    chi = total * F.pow(F.col("a") * n0 - F.col("b") * n1, F.lit(2)) / (n1 * n0 * seen * (total - seen + 1))
    terms = list(PLACES)
    best = tallied.filter((seen >= 4) & (chi > 6)).orderBy(chi.desc(), "feature").limit(n_features).select("feature").collect()
    named = tallied.filter(F.col("feature").isin(terms)).select("feature").collect()
    return sorted({r.feature for r in best} | {r.feature for r in named})


def feature_counts(words: list[str], features: dict[str, int]) -> Counter:
    return Counter(features[f] for w in words for f in starts(w) if f in features)


def swapped_copies(words: list[str]) -> list[list[str]]:
    """The words with the terms of one group moved on around it, for every group named and every distance."""
    out = []
    for g in sorted({g for w in words for g, _ in PLACES.get(w, ())}):
        group = IDENTITY_GROUPS[g]
        at = {w: i for i, w in enumerate(group)}
        for step in range(1, len(group)):
            out.append([group[(at[w] + step) % len(group)] if w in at else w for w in words])
    return out


def feature_values(words: list[str], features: dict[str, int]) -> dict[int, float]:
    """Sparse row of a text: its capped counts, and behind them its capped shares."""
    counts, k = feature_counts(words, features), len(features)
    at = list(counts)
    a, b = values(np.array([counts[j] for j in at], dtype=float), np.array(len(words)))
    return dict(zip(at, a.tolist())) | dict(zip([k + j for j in at], b.tolist()))


def sample_matrix(sample: DataFrame, features: dict[str, int]):
    """Dense feature values, labels and weights of the sample, and the mean over texts with identity terms of the
    products of their feature changes under a swap (None if there is no such text)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for raw, y, w in zip(text_bytes(batch["text"]), batch["label"].to_pylist(), batch["weight"].to_pylist()):
            words = words_of(raw)
            own = feature_values(words, features)
            rows.append((y, w, 0, own))
            copies = swapped_copies(words)
            for copy in copies:
                other = feature_values(copy, features)
                change = {j: own.get(j, 0.0) - other.get(j, 0.0) for j in own.keys() | other.keys()}
                rows.append((y, w, len(copies), {j: v for j, v in change.items() if v}))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64()),
             pa.array([r[2] for r in rows], pa.int32()), pa.array([list(r[3].keys()) for r in rows], pa.list_(pa.int32())),
             pa.array([list(r[3].values()) for r in rows], pa.list_(pa.float64()))],
            ["label", "weight", "copies", "at", "v"])

    got = map_batches(sample.select("text", "label", "weight"), run,
                      "label double, weight double, copies int, at array<int>, v array<double>").toArrow()
    k, copies = 2 * len(features), got["copies"].to_numpy()
    x, products, mentions = np.zeros((int((copies == 0).sum()), k), dtype=np.float32), np.zeros((k, k)), 0.0
    row = 0
    for n, at, v in zip(copies.tolist(), got["at"].to_pylist(), got["v"].to_pylist()):
        if not n:
            x[row, at] = v
            row += 1
        else:
            mentions += 1 / n
            products[np.ix_(at, at)] += np.outer(v, v) / n
    own = copies == 0
    return x, got["label"].to_numpy()[own], got["weight"].to_numpy()[own], products / mentions if mentions else None


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, change: np.ndarray | None, l2: float = 2e-4,
        counterfactual: float = 1.0, rounds: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weighted logistic loss + l2 + mean squared change of the log-odds under identity swaps (``change`` holds the
    mean products of feature changes), by Adam."""
    w = np.zeros(x.shape[1], dtype=np.float32)
    share = float(np.average(y, weights=weight)) if len(y) else 0.0
    share = (share * len(y) + 0.5) / (len(y) + 1)
    b = float(np.log(share / (1 - share)))
    if not x.shape[1]:
        return w, b
    weight = (weight / weight.sum()).astype(np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        err = weight * (p - y)
        g, gb = x.T @ err + l2 * w, float(err.sum())
        if change is not None:
            g = g + counterfactual * (change @ w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate * min(1.0, 2 * (1 - t / (rounds + 1)))
        w = (w - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, n_features: int = N_FEATURES,
          counterfactual: float = 1.0) -> Model:
    sample = labelled_sample(docs, labels, sample_per_class)
    features = {f: i for i, f in enumerate(select_features(sample, n_features))}
    w, b = fit(*sample_matrix(sample, features), counterfactual=counterfactual)
    k = len(features)
    return Model(features, tuple(w[:k].tolist()), tuple(w[k:].tolist()), b)


def score_texts(texts: list[bytes], model: Model, memo: dict[bytes, tuple], limit: int = 400_000) -> list[float]:
    """Scores of whole texts. ``memo`` maps a token to its words and features, and is emptied when full."""
    features, out = model.features, []
    for raw in texts:
        n, counts = 0, {}
        for token in raw.split():
            known = memo.get(token)
            if known is None:
                if len(memo) >= limit:
                    memo.clear()
                words = words_of(token)
                known = memo[token] = (len(words), tuple(features[f] for w in words for f in starts(w) if f in features))
            n += known[0]
            for j in known[1]:
                counts[j] = counts.get(j, 0) + 1
        z = model.intercept
        for j, c in counts.items():
            z += model.count_weights[j] * min(c, 4) / 4 + model.share_weights[j] * min(1.0, 25 * c / n)
        out.append(1 / (1 + float(np.exp(-np.clip(z, -500, 500)))))
    return out


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1), a row per document."""
    src = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")

    def run(batches):
        memo: dict[bytes, tuple] = {}
        for batch in batches:
            got = score_texts(text_bytes(batch["text"]), model, memo)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(got, pa.float64())], ["id", "score"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that score below the threshold, all columns as they are."""
    def run(batches):
        memo: dict[bytes, tuple] = {}
        for batch in batches:
            clean = [s < threshold for s in score_texts(text_bytes(batch[text_col]), model, memo)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return df.mapInArrow(run, df.schema)
