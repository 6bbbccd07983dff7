"""Each pipeline stage against brute force on its own input, and the whole run."""

from collections import Counter

import duckdb
import pytest
from test_bitplane import plain
from test_dart_minhash import brute_classes
from test_secret_scan import plain as plain_spans
from test_toxicity import plain_score

import __spark_entry__
import corpus_pipeline as P
from cohortspark.llm import mixing, toxicity
from cohortspark.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output rows of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        got = stored(stage(spark, docs, SF), "test-stage")
        out.append((name, [tuple(r) for r in docs.collect()], docs.columns, [r for r in got.collect()], got.columns))
        docs = got
    return out


def test_order_and_columns(steps):
    assert [s[0] for s in steps] == ["toxicity", "near-duplicates", "secret scans", "source mix", "packing"]
    assert all(s[4] == s[2] for s in steps[:-1])


def test_toxicity(spark, steps):
    _, rows, cols, got, _ = steps[0]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = [plain_score(r[1], model) for r in rows]
    assert sorted(tuple(r) for r in got) == sorted(r for r, s in zip(rows, scores) if s < 0.7)
    assert len(got) < len(rows)


def test_near_duplicates(steps):
    _, rows, _, got, _ = steps[1]
    classes = brute_classes([(r[0], r[1]) for r in rows])
    assert sorted(tuple(r) for r in got) == sorted(r for r in rows if classes[r[0]] == r[0])


def test_secrets(steps):
    _, rows, _, got, _ = steps[2]
    old = {r[0]: r for r in rows}
    assert len(got) == len(rows)
    for r in got:
        text = old[r.doc_id][1]
        assert (r.text == text) == (not plain_spans(text))
        assert not plain_spans(r.text) and r.n_chars == len(r.text)


def test_mix(steps):
    _, rows, _, got, _ = steps[3]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    want = {d: taken // size for d, size, _, _, taken in con.execute(mixing.ORACLE).fetchall() if size and taken}
    words = {r[0]: len(r[1].split()) for r in rows}
    assert {d: n for d, n in Counter(r.doc_id for r in got).items() if words[d]} == want


def test_packing_and_run(spark, steps):
    _, rows, _, got, _ = steps[4]
    once = {r[0]: r[1] for r in rows}
    ids = dict(zip(once, plain(list(once.values()), 0)))
    copies = Counter(r[0] for r in rows)
    assert sum(r.length for r in got) == sum(len(ids[d]) * n for d, n in copies.items())
    first = [r for r in got if copies[r.doc_id] == 1]
    assert {r.doc_id for r in got} == set(ids)
    by_doc = Counter()
    for r in first:
        by_doc[r.doc_id] += r.length
    assert all(by_doc[d] == len(ids[d]) for d in by_doc)
    assert "pipeline" in __spark_entry__.queries()
    total = P.run(spark, SF).agg({"length": "sum"}).first()[0]
    assert total == sum(r.length for r in got)
