"""Packing: every id once, gapless sequences, little padding."""

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.llm import packing as P
from cohortspark.llm.queries import op6_packing
from test_bitplane import plain
from llm_fixtures import docs_pd  # noqa: F401


def check(rows, ids_of, tiers=P.TIERS):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = ids_of[r.doc_id]
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids_of)
    for pieces, size in [(p, len(ids_of[d])) for d, p in by_doc.items()] + [(p, None) for p in by_seq.values()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == size if size is not None else at <= tiers[0]
    used = [sum(n for _, n in p) for p in by_seq.values()]
    return sum(tiers[0] - u for u in used if u & (u - 1)), sum(used)


def test_whole_table(spark, docs_pd):
    ids = dict(zip(docs_pd.doc_id, plain(docs_pd.text, 0)))
    df = op6_packing(spark, "/root/testdata/sf0.001")
    rows = df.collect()
    padded, used = check(rows, ids)
    assert used == sum(map(len, ids.values())) and padded <= 1024
    groups = defaultdict(int)
    for r in rows:
        groups[r.step_group] += r.length
    assert max(groups.values()) - min(groups.values()) <= 1024


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "word " * 4000, 3), (4, "a", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length int").coalesce(1)
    got = P.pack(df, round_ids=100, with_ids=True).collect()
    check(got, dict(zip([1, 2, 3, 4], plain([r[1] for r in rows], 0))))
    assert P.pack(df.limit(0)).count() == 0
    assert P.pack(df.union(df)).agg({"length": "sum"}).first()[0] == 2 * sum(r.length for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60), st.lists(st.integers(1, 900), max_size=5))
def test_rounds_place_every_id_once(sizes, more):
    docs = dict(enumerate(sizes))
    first, left = P.pack_round(docs, [])
    extra = {len(sizes) + i: n for i, n in enumerate(more)}
    second, rest = P.pack_round(extra, left)
    done = first + second
    assert all(sum(p[0] for p in seq) == tier for tier, seq in done)
    done += P.close(rest)
    seen = defaultdict(list)
    for _, seq in done:
        for n, doc, start in seq:
            seen[doc].append((start, n))
    for doc, n in (docs | extra).items():
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == n
    assert np.sum([sum(p[0] for p in seq) < 128 for _, seq in done]) <= 1
