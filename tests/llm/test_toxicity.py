"""Toxicity: held-out accuracy, counterfactual penalty, odd rows."""

import math
import re

import numpy as np
import pytest

from cohortspark.llm import toxicity as T
from cohortspark.llm.queries import op1_toxicity


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    got = op1_toxicity(spark, sf).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert ((got.predicted == 1) == (got.score >= 0.7)).all()
    d = got[got.held_out].merge(labels[["doc_id", "toxic"]].dropna(), on="doc_id")
    hit = d.predicted == 1
    print("auc", auc(d.toxic.to_numpy(), d.score.to_numpy()), "precision", d.toxic[hit].mean(), "recall", hit[d.toxic == 1].mean())
    assert auc(d.toxic.to_numpy(), d.score.to_numpy()) > 0.93
    assert d.toxic[hit].mean() > 0.9 and hit[d.toxic == 1].mean() > 0.8


def corpus():
    """Toxic texts mention one group more often than clean texts do."""
    rng, rows, labels = np.random.default_rng(5), [], []
    filler = [f"word{i}" for i in range(40)]
    for i in range(600):
        toxic = int(i % 3 == 0)
        words = list(rng.choice(filler, 12))
        if rng.random() < (0.8 if toxic else 0.1):
            words.append("muslims")
        elif rng.random() < 0.5:
            words.append("christians")
        if toxic and rng.random() < 0.7:
            words.append("scumbag")
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_counterfactual_penalty_levels_identity_terms(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    gaps = []
    for strength in (0.0, 20.0):
        model = T.train(docs, lab, counterfactual=strength)
        a, b, bad = T.score_texts([b"the muslims met", b"the christians met", b"scumbag word1 word2"], model, {})
        gaps.append(abs(a - b))
        assert bad > 0.5
    assert gaps[1] < 0.25 * gaps[0]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "scum here", 3.0), (3, "scum " * 50_000, 4.0), (3, "x", 5.0)],
                                 "doc_id bigint, text string, score double")
    lab = spark.createDataFrame([(1, 0), (2, None), (3, 1), (3, 0), (None, 1)], "doc_id bigint, toxic int")
    model = T.train(docs, lab)
    got = T.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert T.keep_clean(docs, model, threshold=1.1).columns == docs.columns
    assert T.keep_clean(docs, model, threshold=1.1).count() == 5
    assert T.score(docs.limit(0), T.train(docs.limit(0), lab.limit(0))).count() == 0


def plain_score(text, model):
    """The score of a text, written a second time."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    z = model.intercept
    for name, j in model.features.items():
        if name.endswith("*"):
            n = sum(w.startswith(name[:-1]) and len(w) > len(name) - 1 for w in words)
        else:
            n = words.count(name)
        z += model.count_weights[j] * min(n, 4) / 4 + (model.share_weights[j] * min(1, 25 * n / len(words)) if words else 0)
    return 1 / (1 + math.exp(-z))


def test_scores_equal_a_plain_scorer(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = T.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    texts = [t for _, t in rows[:60]] + ["", None, "Muslims, MUSLIMS! scumbag-scumbags word1word", "word1 " * 3000, "ünïcode scumbag\x00x", "a_b 1c2"]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in T.score(asked, model).collect()}
    assert len(model.features) > 5
    assert got == pytest.approx({i: plain_score(t, model) for i, t in enumerate(texts)}, abs=1e-9)


def test_each_group_is_a_cycle_in_its_language():
    """All members of every group meet, and a word of two groups moves in each."""
    for group in T.IDENTITY_GROUPS:
        assert len(set(group)) == len(group)
        for word in group:
            copies = [c[0] for c in T.swapped_copies([word])]
            assert set(group) - {word} <= set(copies)
            own = [g for g in T.IDENTITY_GROUPS if word in g]
            assert len(copies) == sum(len(g) - 1 for g in own) and set(copies) <= {w for g in own for w in g}
    for text, foreign in ((["the", "jews", "and", "hindus"], "juden"), (["die", "juden", "und", "hindus"], "jews")):
        for copy in T.swapped_copies(text):
            assert copy[0] == text[0] and (foreign not in copy or copy[1] == text[1])
    assert T.swapped_copies(["nothing", "here"]) == []


def test_every_pair_of_a_group_is_levelled(spark):
    """Texts name one member only; the penalty levels it with all the others, not only with the next one."""
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(10_000 + i, f"the {w} met word{i}") for i, w in enumerate(T.IDENTITY_GROUPS[3] * 4)],
                                 "doc_id bigint, text string")
    lab = spark.createDataFrame(labels + [(10_000 + i, 0) for i in range(32)], "doc_id bigint, toxic int")
    texts = [f"the {w} met".encode() for w in T.IDENTITY_GROUPS[3]]
    plain, level = (T.score_texts(texts, T.train(docs, lab, counterfactual=c), {}) for c in (0.0, 1.0))
    assert max(level) - min(level) < 0.25 * (max(plain) - min(plain))


def test_repeated_ids_stay_within_the_bound(spark):
    """A sample of ten a class from rows of which most share a few ids: one text per id reaches the driver."""
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(4000)], "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    sample = T.labelled_sample(docs, lab, 10).collect()
    assert len({r.id for r in sample}) == len(sample) <= 40
    assert all(r.text == max(f"text {i}" for i in range(r.id, 4000, 40)) for r in sample)
