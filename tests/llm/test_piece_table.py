"""Fill-in-the-middle: contract against DuckDB and a second writing, round trip, odd rows."""

import hashlib
import re

import duckdb

from cohortspark.llm import piece_table as P
from cohortspark.llm.queries import op13_piece_table

LONG = "Zeile ü\n" * 60_000 + "kein Ende"
TEXTS = [(1, "a\nb\nc\n"), (2, "one line"), (3, ""), (4, None), (5, "has <P> inside\nx"), (6, "\n\n\n"), (7, "é日本\n🎈 x\r\ny"),
         (None, "no id\nat all\n"), (None, "no id\nat all\n"), (8, LONG), (9, " \t\n <M>"), (1, "a\nb\nc\n")]


def plain(doc_id, text):
    """The contract, written a second time over code points."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    hx = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hx[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        form, out = "plain", text
    elif h[3] % 100 < 50:
        form, out = "spm", "<S>" + suf + "<P>" + pre + "<M>" + mid
    else:
        form, out = "psm", "<P>" + pre + "<S>" + suf + "<M>" + mid
    is_plain = form == "plain"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, n, form, None if is_plain else len(pre), None if is_plain else len(mid), sha(out), sha(text)), out


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, form string, n int")


def key(row):
    return tuple((v is None, v or 0) for v in row)


def test_odd_rows_equal_a_second_writing(spark):
    got = sorted((tuple(r) for r in P.digest(frame(spark)).collect()), key=key)
    assert got == sorted((plain(i, t)[0] for i, t in TEXTS), key=key)
    assert P.digest(frame(spark, [])).count() == 0


def test_output_and_restored_text(spark):
    """``rearrange`` keeps clashing columns; its descriptors spell the output; ``restore`` needs only output and form."""
    out = P.rearrange(frame(spark))
    assert out.columns == ["doc_id", "text", "form", "n", "fim"]
    back = P.restore(out.selectExpr("doc_id", "text AS original", "form", "fim.form AS fim_form", "fim.output AS fim_output",
                                    "fim.pieces AS pieces"), "fim_form", "fim_output").collect()
    want = {(i, t or ""): plain(i, t) for i, t in TEXTS}
    assert len(back) == len(TEXTS)
    for r in back:
        digest, output = want[(r.doc_id, r.original or "")]
        assert (r.fim_form, r.fim_output, r.text) == (digest[2], output, r.original or "")
        buffers = ((r.original or "").encode(), b"<P><S><M>")
        assert b"".join(buffers[p.buffer][p.start:p.start + p.length] for p in r.pieces).decode() == output


def test_rates_and_sentinels(spark):
    rows = [(i, "x\ny\nz\n") for i in range(400)]
    forms = P.rearrange(frame(spark, rows), fim_rate=30, spm_rate=100, sentinels=("[[a]]", "[[b]]", "[[c]]")).select("fim.*").collect()
    arranged = [f for f in forms if f.form != "plain"]
    assert 80 < len(arranged) < 160 and all(f.form == "spm" and f.output.startswith("[[b]]") for f in arranged)


def test_every_cut_comes_back():
    """Plain Python: all splits of a text, both forms."""
    marks = P.Marks.of(P.SENTINELS)
    text = "ä\n\nb\nc".encode()
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            whole = P.Piece(P.TEXT, 0, len(text))
            prefix, rest = whole.cut(a)
            middle, suffix = rest.cut(b - a)
            for form in P.ARRANGED:
                output = P.write_out(P.arrange([prefix, middle, suffix], form, marks), (text, marks.buffer))
                assert P.write_out(P.parse(output, form, marks), (output,)) == text


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(P.ORACLE).fetchall()
    got = [tuple(r) for r in op13_piece_table(spark, sf).collect()]
    assert len(got) == 1000 and sorted(got) == sorted(want)
    assert {r[2] for r in got} == {"psm", "spm"}
