"""Language identification: n-grams and scores against a plain writing, held-out accuracy, odd rows."""

import math
from collections import Counter

import numpy as np
import pytest

from cohortspark.llm import language_id as L
from cohortspark.llm.queries import op12_language_id


def plain_bucket(gram):
    h = (gram[0] * 0x9E3779B1) % 2**32
    for c in gram[1:]:
        h = ((h + c) * 0x9E3779B1) % 2**32
    return h >> (32 - L.BUCKET_BITS)


def plain_buckets(text):
    """All buckets of a text, word by word."""
    text = text.lower()
    words, word = [], []
    for ch in text + " ":
        if ch.isalpha():
            word.append(ord(ch))
        elif word:
            words.append(word)
            word = []
    out = Counter()
    for w in words:
        padded = [0, *w, 0]
        out.update(plain_bucket([c]) for c in w)
        for n in (2, 3, 4):
            out.update(plain_bucket(padded[i:i + n]) for i in range(len(padded) - n + 1))
    return out


TEXTS = ["Hello, world!", "", "a", "42 !!", "É à ß x-y", "日本語 テスト", "one\n\ntwo  three", "İstanbul", "z"]


def test_ngrams_equal_plain_words():
    got = [Counter() for _ in TEXTS]
    for bucket, offsets in L.ngrams(TEXTS):
        assert len(offsets) == len(TEXTS) + 1
        for k in range(len(TEXTS)):
            got[k].update(bucket[offsets[k]:offsets[k + 1]].tolist())
    assert got == [plain_buckets(t) for t in TEXTS]


def test_one_text_alone():
    for text in [*TEXTS, "ab " * 5]:
        got = Counter(b for bucket, _ in L.ngrams([text]) for b in bucket.tolist())
        assert got == plain_buckets(text)


def test_slices_do_not_change_the_ngrams(monkeypatch):
    text = "lorem ipsum dolor sit amet consectetur " * 30
    want = plain_buckets(text)
    monkeypatch.setattr(L, "SLICE", 64)
    parts = list(L.slices(text))
    assert "".join(parts) == text and max(map(len, parts)) <= 64 and len(parts) > 10
    assert Counter(b for bucket, _ in L.ngrams(parts) for b in bucket.tolist()) == want
    assert "".join(L.slices("x" * 200)) == "x" * 200


def plain_model(rows):
    counts, docs = {}, Counter()
    for lang, text in rows:
        counts.setdefault(lang, Counter()).update(plain_buckets(text or ""))
        docs[lang] += 1
    return counts, docs


def plain_predict(model, text):
    counts, docs = model
    grams = plain_buckets(text or "")
    if not grams or not counts:
        return "und", 0.0
    z = {}
    for lang in sorted(counts):
        total = sum(counts[lang].values()) + L.SMOOTHING * 2**L.BUCKET_BITS
        z[lang] = math.log(docs[lang] / sum(docs.values())) + sum(
            k * math.log((counts[lang][g] + L.SMOOTHING) / total) for g, k in grams.items())
    best = max(sorted(z), key=z.get)
    return best, 1 / sum(math.exp(v - z[best]) for v in z.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string, lang_pred_2 string")


def test_model_and_scores_equal_a_plain_writing(spark):
    train = [(1, "der hund und die katze", "de"), (2, "the dog and the cat", "en"), (3, None, "en"), (4, "le chien", None),
             (5, "", "de"), (6, "el perro y el gato", "es"), (6, "el perro y el gato", "es")]
    docs = frame(spark, [(i, t, lang, "s", None) for i, t, lang in train]).drop("score")
    model = L.train(docs)
    assert model.langs == ("de", "en", "es")
    want = plain_model([(lang, t) for _, t, lang in train if lang])
    long = "und der gato " * 40_000
    asked = [(1, "die katze"), (2, "cat"), (3, None), (4, ""), (5, "123 ..."), (6, "日本"), (7, "x"), (8, long), (None, "el gato"), (1, "die katze")]
    got = L.predict(spark.createDataFrame(asked, "doc_id bigint, text string"), model).collect()
    assert len(got) == len(asked)
    for r in got:
        lang, score = plain_predict(want, r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-9)


def test_no_language_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    model = L.train(docs)
    assert [(r.lang_pred, r.score) for r in L.predict(docs, model).collect()] == [("und", 0.0)]
    assert L.predict(docs.limit(0), model).count() == 0
    one = L.train(spark.createDataFrame([(1, "some text", "en")], "doc_id bigint, text string, lang string"))
    assert [(r.lang_pred, r.score) for r in L.predict(docs, one).collect()] == [("en", 1.0)]


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGS", 2)
    docs = spark.createDataFrame([(i, "t", f"l{i}") for i in range(3)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError):
        L.train(docs)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    got = op12_language_id(spark, sf).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) == 10_000 and got.score.between(0, 1).all()
    held = got[got.held_out]
    print("held-out accuracy", (held.lang_pred == held.lang).mean(), "of", len(held))
    assert (held.lang_pred == held.lang).mean() > 0.97


def test_short_words_of_each_language(spark):
    """Texts of a few words, unseen in training."""
    rows = [("en", "the of and"), ("de", "der und nicht"), ("fr", "les dans qui"), ("es", "los para que")]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs)
    got = L.predict(spark.createDataFrame(rows, "want string, text string"), model).collect()
    assert [r.lang_pred for r in got] == [r.want for r in got]
    assert np.isfinite(model.log_probs).all()
