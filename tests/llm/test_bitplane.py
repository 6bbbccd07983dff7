"""Plane files: exact round trip, order, whole-table ids."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortspark.llm import bitplane as B
from cohortspark.llm.common import bpe_path, work_path
from cohortspark.llm.queries import op2_bitplane
from llm_fixtures import docs_pd  # noqa: F401


def plain(texts, end):
    tok = Tokenizer.from_file(bpe_path())
    return [np.array(e.ids + [end], "<u4") for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("plane", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_are_inverse(plane, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert (B.from_planes(B.to_planes(ids, plane), n, plane) == ids).all()


def test_whole_table(spark, docs_pd):
    d = docs_pd.sort_values("doc_id")
    want, start = {}, 0
    for i, ids in zip(d.doc_id, plain(d.text, 2)):
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op2_bitplane(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_odd_rows_and_small_blocks(spark, plane):
    rows = [(3, "x " * 5000, 1), (1, None, 2), (2, "", 3), (2, "", 3), (None, "null id", 4), (5, "end", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int").repartition(3)
    folder = work_path(spark, "test-planes")
    files = B.write_ids(df, folder, plane=plane, block_ids=64)
    back = B.read_ids(spark, folder, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None, 1, 2, 2, 3, 5]
    by_id = {r[0]: r[1] for r in rows}
    assert [r.ids for r in back] == [x.tolist() for x in plain([by_id[r.doc_id] for r in back], 2)]
    assert [r.start for r in back] == np.cumsum([0] + [r.n_tokens for r in back[:-1]]).tolist()
    assert files.agg({"n_docs": "sum"}).first()[0] == len(rows)
    assert B.round_trip(df.limit(0)).count() == 0


def test_rows_without_id_are_spread_and_keep_one_order(spark, monkeypatch):
    """Two thirds of the rows have no id: they go to several files, and the files read as one sequence."""
    rows = [(None if i % 3 else i, f"text number {i} <|endoftext|> " + "x " * (i % 7)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    monkeypatch.setattr(B, "ROWS_OF_AN_ID", 100)
    folder = work_path(spark, "test-nulls")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # small files would be merged
    try:
        files = B.write_ids(df, folder).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(f.n_docs for f in files) < 500
    back = B.read_ids(spark, folder, with_ids=True).orderBy("start").collect()
    assert [r.start for r in back] == np.cumsum([0] + [r.n_tokens for r in back[:-1]]).tolist()
    ids = [r.doc_id for r in back]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len(ids) == 900
    want = sorted(tuple(x) for x in plain([t for _, t in rows], 2))
    assert sorted(tuple(r.ids) for r in back) == want and any(50256 in w for w in want)
