"""Rule ledger against per-text brute force."""

import re
from collections import Counter

import pytest

from cohortspark.llm import rule_ledger as R
from cohortspark.llm.queries import op8_rule_ledger
from llm_fixtures import docs_pd  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    n, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            cover.update(range(i, i + 5))
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))


TEXTS = [None, "", "  \n\t", "one", "a b c d e " * 30, "é ü x\x1cy #*$%&|<>\n\nline\nline\n line\nline", "z" * 200_000,
         "a b c d e f a b c d e g", "w " * 4, "x x x y y z z z z w w v u u", "aa bb cc dd ee\naa bb cc dd ee\n" + " ".join(f"q{i}" for i in range(50))]


def test_measures(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(4, TEXTS[4])], "doc_id bigint, text string")
    rows = R.verdict(R.ledger(R.measure(df))).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = brute(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
        ws = WORD.findall(TEXTS[r.doc_id] or "")
        assert r.n_stutter == sum(a == b for a, b in zip(ws, ws[1:]))


def test_whole_table_equals_brute_force(spark, docs_pd):
    got = {r.doc_id: r for r in op8_rule_ledger(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs_pd)
    for i, t in zip(docs_pd.doc_id, docs_pd.text):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t)


def test_policies_and_ablation_agree_with_direct_counts(spark, docs_pd):
    led = R.ledger(R.measure(spark.createDataFrame(docs_pd[["doc_id", "text"]]))).toPandas()
    abl = {r.rule: r for r in R.ablation(spark.createDataFrame(led), "v2").collect()}
    for i, rule in enumerate(R.RULES):
        if rule not in R.POLICIES["v2"]:
            continue
        mask = R.bits(R.POLICIES["v2"])
        without = ((led.fail_bits & (mask & ~(1 << i))) == 0).sum()
        assert abl[rule].rejects == ((led.fail_bits & (1 << i)) != 0).sum()
        assert abl[rule].kept_without == without
        assert abl[rule].kept == ((led.fail_bits & mask) == 0).sum()
    assert R.ablation(spark.createDataFrame(led).limit(0)).count() == len(R.POLICIES["v2"])


def test_stored_ledger_answers_later_policies(spark, docs_pd, tmp_path, monkeypatch):
    """A ledger is measured once; verdicts and ablations of any policy come from the stored bits, other rules refuse it."""
    df = spark.createDataFrame(docs_pd[["doc_id", "text"]])
    led = R.store_ledger(df, str(tmp_path / "ledger"))
    monkeypatch.setattr(R, "measure", None)          # nothing is measured again
    again = R.open_ledger(spark, str(tmp_path / "ledger"))
    for policy in R.POLICIES:
        got, mask = R.with_ablation(again, policy).toPandas(), R.bits(R.POLICIES[policy])
        alone = {r: int(((got.fail_bits & mask) == R.bits([r])).sum()) for r in R.POLICIES[policy]}
        assert len(got) == len(docs_pd) and (got.kept == ((got.fail_bits & mask) == 0)).all()
        for row in got.itertuples():
            hit = row.fail_bits & mask
            one = [r for r in R.POLICIES[policy] if hit == R.bits([r])]
            assert (row.lone_rule if isinstance(row.lone_rule, str) else None) == (one[0] if one else None)
            assert not one or row.returns_without == alone[one[0]]
    assert led.count() == again.count()
    monkeypatch.setitem(R.RULES, "few_words", "n_words < 11")
    with pytest.raises(ValueError):
        R.open_ledger(spark, str(tmp_path / "ledger"))
