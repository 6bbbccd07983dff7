"""DartMinHash: agreement equals similarity; classes equal brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import dart_minhash as D
from llm_fixtures import docs_pd  # noqa: F401


def units(text, width=5):
    ws = (text or "").encode().split()
    c = Counter(tuple(ws[i:i + width]) for i in range(len(ws) - width + 1)) if len(ws) >= width else Counter([tuple(ws)] if ws else [])
    return c


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows):
    """doc -> smallest doc of its component over all pairs at 0.8."""
    sets = {d: units(t) for d, t in rows}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (not sets[a] and not sets[b]) or (sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def edited(rng, words, n):
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"edit{rng.integers(10**9)}"
    return words


@pytest.mark.parametrize("edits", [2, 6, 15])
def test_agreement_estimates_weighted_jaccard(edits):
    rng = np.random.default_rng(edits)
    base = [f"w{rng.integers(60)}" for _ in range(300)] + ["again"] * 40
    other = edited(rng, base, edits)
    texts = [" ".join(base).encode(), " ".join(other).encode()]
    doc, element, weight = D.shingles(texts)
    k = 4000
    sig = D.signatures(2, doc, element, weight.astype(float), k)
    assert np.isfinite(sig).all()
    want = jaccard(units(texts[0].decode()), units(texts[1].decode()))
    assert abs((sig[0] == sig[1]).mean() - want) < 5 * np.sqrt(want * (1 - want) / k) + 1e-3


def test_signature_does_not_depend_on_its_batch():
    texts = [b"a b c d e f g", b"x", b"", b"a b c d e f g " * 400]
    alone = [D.document_rows([t], 40, 6) for t in texts]
    joint = D.document_rows(texts, 40, 6)
    for i, one in enumerate(alone):
        assert all((one[c][0] == joint[c][i]).all() for c in one)


def corpus():
    rng, rows = np.random.default_rng(3), []
    passage = [f"shared{i}" for i in range(60)]
    for g in range(12):
        base = [f"g{g}w{rng.integers(400)}" for _ in range(120)]
        for c in range(1 + g):
            rows.append(base if c % 4 == 3 else edited(rng, base, int(rng.integers(0, 4))))
    hub = [f"h{rng.integers(900)}" for _ in range(200)]
    rows += [edited(rng, hub, 4) for _ in range(60)] + [hub]       # copies are often closer to the original than to each other
    rows += [passage + [f"p{i}x{j}" for j in range(40)] for i in range(50)]
    rows += [["one"], ["one"], ["two", "words"], []]
    texts = [" ".join(r) for r in rows] + [None, "  \n ", "huge " * 40_000, "huge " * 40_001]
    order = rng.permutation(len(texts))
    return [(int(i), texts[j]) for i, j in enumerate(order)]


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, class_id string")
    got = {r.doc_id: r.class_id for r in D.near_duplicates(df).collect()}
    assert got == brute_classes(rows)
    kept = D.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_repeated_rows_missing_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "z"),
                                (3, None), (4, "")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.class_size) for r in D.near_duplicates(df).collect())
    assert got == [(0, 0, 1), (0, 1, 4), (1, 1, 4), (1, 1, 4), (2, 1, 4), (3, 3, 2), (4, 3, 2)]
    kept = sorted((r.doc_id or 0, r.text) for r in D.keep_one(df).collect() if r.text is not None)
    assert kept == [(0, "a b c d e f"), (0, "z"), (1, "a b c d e f")]
    assert D.near_duplicates(df.limit(0)).count() == 0


def test_whole_table_equals_brute_force(spark, docs_pd):
    df = spark.createDataFrame(docs_pd[["doc_id", "text"]])
    got = {r.doc_id: r.class_id for r in D.near_duplicates(df).collect()}
    assert got == brute_classes(list(zip(docs_pd.doc_id.tolist(), docs_pd.text.tolist())))


def test_hot_buckets_are_compared_block_by_block(spark, monkeypatch):
    """Templated texts around the threshold share buckets; with blocks of three nodes the classes are the same."""
    rng = np.random.default_rng(8)
    template = [f"t{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, template, int(rng.integers(2, 9))))) for i in range(120)] + corpus_tail(rng)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_classes(rows)
    monkeypatch.setattr(D, "BUCKET_BLOCK", 3)
    assert {r.doc_id: r.class_id for r in D.near_duplicates(df).collect()} == want
    assert 1 < len(set(want.values())) < len(rows)


def corpus_tail(rng):
    other = [f"o{rng.integers(500)}" for _ in range(90)]
    return [(200 + i, " ".join(edited(rng, other, 5))) for i in range(20)]


def test_two_nodes_of_a_bucket_meet_once(spark, monkeypatch):
    monkeypatch.setattr(D, "BUCKET_BLOCK", 10)
    rest = spark.createDataFrame([(k, n) for k, size in ((1, 95), (2, 4)) for n in range(size)], "key bigint, node bigint")
    able = rest.select("node").distinct()
    hot = D.hot_buckets(rest, able)
    assert [tuple(r) for r in hot.collect()] == [(1, 10)]
    x, y = D.in_blocks(rest, hot).alias("x"), D.in_blocks(rest, hot, every=True).alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.node") < F.col("y.node")))
    pairs = [tuple(r) for r in met.select("x.key", "x.node", "y.node").collect()]
    assert len(pairs) == len(set(pairs)) == 95 * 94 // 2 + 6
    assert max(r["n"] for r in D.in_blocks(rest, hot).groupBy("key", "block").agg(F.count("*").alias("n")).collect()) < 25
