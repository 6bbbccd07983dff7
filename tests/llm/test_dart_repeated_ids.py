"""Rows that share an id: one row of each class stays, whichever partition comes first."""

from cohortspark.llm import dart_minhash as D


def words(prefix, n=60):
    return " ".join(f"{prefix}{i}" for i in range(n))


def test_rows_of_one_id_in_several_classes(spark):
    near = words("c") + " end"
    rows = [(5, words("a"), "x"), (5, words("b"), "y"),                                   # two classes, both led by 5
            (3, words("c"), "x"), (7, near, "x"), (7, words("d"), "y"),                   # 7 is a duplicate in one class, leads the other
            (8, words("e"), "z"), (8, words("e"), "y"), (8, words("e") + " end", "a"),    # one class, three rows
            (9, words("b"), "x"), (None, words("c"), "x"), (2, None, "x"), (2, "", "y"), (4, " ", "x")]
    want = [(2, None, "x"), (3, words("c"), "x"), (5, words("a"), "x"), (5, words("b"), "y"),
            (7, words("d"), "y"), (8, words("e"), "y"), (None, words("c"), "x")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id bigint, text string, source string").repartition(3)
        out = D.keep_one(df)
        assert out.schema.names == df.schema.names
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_odd_column_types(spark):
    rows = [(1, words("a"), {"k": 1}, [1.5], b"x"), (1, words("b"), {"k": 2}, None, None), (1, words("b"), {"k": 2}, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, m map<string,int>, a array<double>, b binary")
    out = D.keep_one(df).collect()
    assert sorted((r.text[:2], r.m["k"], r.a) for r in out) == [("a0", 1, [1.5]), ("b0", 2, None)]
