"""Secret scans against a plain search over whole texts."""

import hashlib
import re
import zlib

from cohortspark.llm import secret_scan as S
from cohortspark.llm.queries import op10_secret_scan
from llm_fixtures import docs_pd  # noqa: F401

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def github(body="A" * 30):
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = S.BASE62[d] + digits
    return "ghp_" + body + digits


TEXTS = [None, "", " ", "token: secret: abcdefghijklmnop", "password=token=abcdefghijklmnop",
         "é PASSWORD = 'abcdefghijkl' ü Api_Key:xyz api_key=0123456789abcdef0", "passſwd=abcdefghijklmn",
         "AKIAAKIAAKIAAKIAAK akia AKIA" + "B" * 14, "0123456789abcdef" * 3, "x" * 300_000 + " secret=" + "q" * 40,
         "toKen" * 2000 + "=abcdefghijklmnopq", "Kpassword=aaaaaaaaaaaaaa", github(), github()[:-1] + "?",
         "AGE-SECRET-KEY-1" + "Q" * 58, "日本 token=" + "a" * 16 + " " + github("b" * 30)]


def test_base_spans_equal_plain_search(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3])], "doc_id bigint, text string")
    rows = S.secret_report(df).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        base = plain(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in S.KINDS[:3] and s] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in S.KINDS[:3])


def test_checksums():
    good = github().encode()
    assert [k for *_, k in S.spans_of(b"x " + good)] == ["github"]
    assert S.spans_of(good[:-1] + (b"0" if good[-1:] != b"0" else b"1")) == []
    assert S.bech32_ok(b"A12UEL5L") and not S.bech32_ok(b"A12UEL5M")   # test vector of BIP 173


def test_whole_table_equals_brute_force(spark, docs_pd):
    got = {r.doc_id: r for r in op10_secret_scan(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs_pd)
    for i, t in zip(docs_pd.doc_id, docs_pd.text):
        assert got[i].base_sha256 == hashlib.sha256(",".join(plain(t)).encode()).hexdigest()


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "a token=abcdefghijklmnop b", 26, "s"), (2, None, None, None), (3, "clean", 5, "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, spans string")
    got = sorted(map(tuple, S.redact_secrets(df).collect()))
    assert got == [(1, "a [SECRET] b", 12, "s"), (2, None, None, None), (3, "clean", 5, "t")]
    assert S.secret_report(df.limit(0)).count() == 0
