"""Mixing: oracle definition, targets, nesting, odd rows."""

import duckdb
import pytest

from cohortspark.llm import mixing as M
from cohortspark.llm.queries import op7_mixing
from llm_fixtures import docs_pd  # noqa: F401


def reshare(sizes, weights=(1, 2, 3), most=3):
    """Targets by literal resharing of the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return con.execute(M.ORACLE).fetchall()


def run(spark, rows):
    return [tuple(r) for r in M.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).select(
        "doc_id", "size", "source_size", "target", "taken").collect()]


def norm(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


ROWS = ([(i, " ".join(["w"] * (1 + i * 37 % 90)), "hot") for i in range(400)]
        + [(1000 + i, "x y\tz\n" * (i % 5), f"s{i % 7}") for i in range(60)]
        + [(2000 + i, "a b", None) for i in range(9)]
        + [(3000, None, "s1"), (3001, "", "empty"), (None, "q r", "s2"), (5, " ".join(["w"] * (1 + 5 * 37 % 90)), "hot"),
           (4000, "long " * 30000, "giant")])


def test_equals_oracle_and_targets(spark):
    got, want = norm(run(spark, ROWS)), norm(oracle(ROWS))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(a[3] == pytest.approx(b[3]) for a, b in zip(got, want))
    sizes, taken, biggest = {}, {}, {}
    by_id = {r[0]: r[2] for r in ROWS}
    for doc, size, _, _, t in got:
        s = by_id[doc]
        sizes[s], taken[s] = sizes.get(s, 0) + size, taken.get(s, 0) + t
        biggest[s] = max(biggest.get(s, 0), size)
        assert t <= 3 * size
    target = reshare(sizes)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= biggest[s] + 1e-6
    assert {by_id[r[0]]: r[3] for r in got} == pytest.approx(target)
    assert norm(run(spark, ROWS[::-1])) == got


def test_whole_table(spark, docs_pd):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = norm(con.execute(M.ORACLE).fetchall())
    got = norm([tuple(r) for r in op7_mixing(spark, "/root/testdata/sf0.001").collect()])
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]


def test_mixed_rows_and_empty_table(spark):
    df = spark.createDataFrame([(d, t, s, 7) for d, t, s in ROWS], "doc_id bigint, text string, source string, size int")
    out = M.apply_mix(df)
    assert out.columns == df.columns
    counts = {(r[0], r[1]): 0 for r in run(spark, ROWS)}
    taken = sum(r[4] for r in run(spark, ROWS))
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == taken and counts
    assert M.mix(df.limit(0)).count() == 0


def test_rows_without_id_come_near_their_target(spark):
    """A source of equal rows without ids, one of rows without ids that differ, and one of repeated rows."""
    rows = ([(None, "w " * 10, "a")] * 1000 + [(None, f"x{i} " * 7, "b") for i in range(300)]
            + [(5, "same words here", "c")] * 700 + [(5, "other words " * 4, "c")] * 90 + [(i, "t " * 50, "d") for i in range(40)])
    got, want = run(spark, rows), oracle(rows)
    assert sorted(map(str, got)) == sorted(map(str, want))
    by_source = {"a": [r for r in got if r[1] == 10], "d": [r for r in got if r[1] == 50]}
    for mine in by_source.values():
        assert abs(sum(r[4] for r in mine) - mine[0][3]) <= mine[0][1]
    target, taken = {}, {}
    for r in got:
        target[r[2]], taken[r[2]] = r[3], taken.get(r[2], 0) + r[4]
    assert all(abs(taken[s] - target[s]) <= 50 for s in target)
    # the mixed table holds what the mix takes, also where equal rows differ in a column that is not mixed by
    df = spark.createDataFrame([(*r, i % 3) for i, r in enumerate(rows)], "doc_id bigint, text string, source string, size int")
    out = M.apply_mix(df).collect()
    assert out and sum(len(r.text.split()) for r in out) == sum(r[4] for r in got)
    assert sorted(map(str, out)) == sorted(map(str, M.apply_mix(df).collect()))
