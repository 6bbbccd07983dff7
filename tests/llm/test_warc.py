"""WARC: round trip, revisits, salvage of damaged files."""

import base64
import hashlib
import io
import os
import random
import zlib
from urllib.parse import urlparse

import duckdb
import pytest

from cohortspark.llm import warc as W
from cohortspark.llm.common import work_path
from cohortspark.llm.queries import op5_warc


class Source(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def member(i, body, plain=False):
    raw = W.record_bytes(i, f"u{i}", body, W.digest_text(body), None, "response")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return raw if plain else z.compress(raw) + z.flush()


def read(data, window=1 << 12):
    out = list(W.salvage(Source(data), len(data), window))
    return [x for x in out if isinstance(x, W.Record)], [x for x in out if not isinstance(x, W.Record)]


def test_contract_on_odd_rows(spark):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, None, None), (5, "u\r\n5", ""), (4, "u4", "é" * 100_000), (7, "u7", "x"), (7, "u7", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumnRenamed("url", "url")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.round_trip(df).collect()
                 if r.status == "ok")
    same = [(1, 4, b32("same"), "response", None), (2, 0, b32(""), "response", None), (3, 4, b32("same"), "revisit", 1),
            (4, 200_000, b32("é" * 100_000), "response", None), (5, 0, b32(""), "revisit", 2)]
    assert got[:5] == same
    assert [g[3:] for g in sorted(got[5:], key=str)] == [("response", None), ("revisit", 7)]
    assert all(r.record_type == "response" for r in W.round_trip(df.limit(5), min_bytes=10**6).collect())
    assert W.round_trip(df.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, None, "a"), (None, None, "b")], "page_id bigint, url string, html string")
    assert {(r.page_id, r.payload_digest) for r in W.round_trip(lost).collect()} == {(None, b32("a")), (None, b32("b"))}


def test_whole_table_equals_oracle(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = sorted(con.execute(W.ORACLE).fetchall())
    got = sorted(tuple(r) for r in op5_warc(spark, "/root/testdata/sf0.001").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == want


@pytest.mark.parametrize("window", [1 << 9, 1 << 12, 1 << 20])
def test_salvage_finds_all_whole_records(window):
    rng = random.Random(window)
    bodies = [rng.randbytes(rng.randrange(0, 3000)) for _ in range(60)] + [b"\x1f\x8b\x08 decoy WARC/1.0 decoy", rng.randbytes(40_000)]
    parts = [member(i, b, plain=i % 7 == 3) for i, b in enumerate(bodies)]
    clean = b"".join(parts)
    records, gaps = read(clean, window)
    assert [r.payload for r in records] == bodies and not gaps

    damaged, hurt = [], set()
    for i, p in enumerate(parts):
        kind = rng.randrange(6)
        if kind == 0:
            at = rng.randrange(len(p))
            p, _ = p[:at] + bytes([p[at] ^ 0x55]) + p[at + 1:], hurt.add(i)
        elif kind == 1:
            p, _ = p[:rng.randrange(len(p))], hurt.add(i)
        damaged.append(p)
        if kind == 2:
            damaged.append(rng.randbytes(rng.randrange(1, 900)))
    data = b"".join(damaged)
    records, gaps = read(data, window)
    found = {r.page_id for r in records}
    assert found >= set(range(len(parts))) - hurt
    assert all(r.payload == bodies[r.page_id] for r in records)
    covered = sorted([(r.offset, r.length) for r in records] + [g[:2] for g in gaps])
    at = 0
    for start, length in covered:
        assert start == at
        at += length
    assert at == len(data)


def test_damaged_file_in_folder(spark):
    df = spark.createDataFrame([(i, f"u{i}", f"body {i} " * (i + 1)) for i in range(40)], "page_id bigint, url string, html string")
    folder = work_path(spark, "warc-test")
    files = W.write_archives(df.coalesce(1), folder).collect()
    path = os.path.join(urlparse(folder).path, files[0].file)
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 0xFF
    with open(path, "wb") as f:
        f.write(data)
    rows = W.read_archives(spark, folder, with_payload=True).collect()
    gaps = [r for r in rows if r.status == "gap"]
    assert len(gaps) == 1 and gaps[0].reason
    assert len([r for r in rows if r.status == "ok"]) == 39
    assert all(r.payload.decode() == f"body {r.page_id} " * (r.page_id + 1) for r in rows if r.status == "ok")


class Counting(Source):
    """Counts the bytes read and the largest read."""

    def __init__(self, data):
        super().__init__(data)
        self.total = self.largest = 0

    def read_at(self, n, at):
        self.total, self.largest = self.total + n, max(self.largest, n)
        return super().read_at(n, at)


def test_one_bad_length_costs_one_record_and_one_window():
    """A plain stretch of 6,000 records, one with a length that points behind the end of the file, one that points
    to the end of a far record: both are gaps, and the file is read about once."""
    parts = [member(i, b"body %d " % i * 40, plain=True) for i in range(6000)]
    size = sum(map(len, parts))
    parts[100] = parts[100].replace(b"Content-Length: ", b"Content-Length: 9")
    parts[100] = parts[100].replace(b"Content-Length: 9", b"Content-Length: 999999999")
    far = sum(map(len, parts[201:5000]))
    at = parts[200].index(b"\r\n\r\n") + 4
    own = len(parts[200]) - at - 4
    parts[200] = parts[200].replace(b"Content-Length: %d" % own, b"Content-Length: %d" % (own + far))
    source = Counting(b"".join(parts))
    window = 1 << 16
    out = list(W.salvage(source, len(source.getvalue()), window))
    records, gaps = [x for x in out if isinstance(x, W.Record)], [x for x in out if not isinstance(x, W.Record)]
    assert {r.page_id for r in records} == set(range(6000)) - {100, 200}
    assert [g[2] for g in gaps] == ["body is cut short", "digest of a large body"]
    assert source.largest <= window and source.total < 3 * size


def http(kind, body, record_id, content_type="application/http; msgtype=response", digest=True, chunked=False, extra=()):
    """A record as other writers make them."""
    sent = b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body) if chunked else body
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + b"Transfer-Encoding: chunked\r\n" * chunked + b"\r\n" + sent
    if kind in ("warcinfo", "metadata"):
        block = body
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", "WARC-Date: 2024-05-05T00:00:00Z",
            "warc-target-uri:http://example.org/", f"Content-Type: {content_type}", "X-Folded: one", "  two", *extra]
    if digest:
        head += [f"WARC-Payload-Digest: sha1:{W.digest_text(body)}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    raw = "\r\n".join(["WARC/1.0", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return raw


@pytest.mark.parametrize("zipped", [True, False])
def test_records_of_other_writers(zipped):
    raw = [http("warcinfo", b"software: x", 1, "application/warc-fields", digest=False), http("request", b"GET /", 2, digest=False),
           http("response", b"<p>one</p>" * 900, 3), http("response", b"two", 4, chunked=True),
           http("metadata", b"a: b", 5, "application/warc-fields", digest=False),
           http("revisit", b"", 6, extra=["WARC-Refers-To: <urn:uuid:3>"], digest=False),
           http("response", b"damaged", 7).replace(b"damaged", b"dbmaged"), http("response", b"last", 8, digest=False)]
    data = b"".join((lambda z: z.compress(r) + z.flush())(zlib.compressobj(6, zlib.DEFLATED, 31)) if zipped else r for r in raw)
    records, gaps = read(data, 1 << 12)
    assert [(r.kind, r.record_id) for r in records] == [(k, f"<urn:uuid:{i}>") for k, i in (
        ("warcinfo", 1), ("request", 2), ("response", 3), ("response", 4), ("metadata", 5), ("revisit", 6), ("response", 8))]
    assert [g[2] for g in gaps] == ["block digest"]
    by = {r.record_id: r for r in records}
    assert by["<urn:uuid:3>"].payload == b"<p>one</p>" * 900 and by["<urn:uuid:3>"].page_id is None
    assert by["<urn:uuid:6>"].refers_to_id == "<urn:uuid:3>" and by["<urn:uuid:6>"].payload_bytes is None
    assert by["<urn:uuid:8>"].url == "http://example.org/"


def test_a_member_is_unzipped_no_further_than_its_length():
    raw = W.record_bytes(1, "u", b"x", W.digest_text(b"x"), None, "response") + bytes(1 << 24)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    bomb = z.compress(raw) + z.flush()
    records, gaps = read(bomb + member(2, b"after"))
    assert [r.page_id for r in records] == [2] and gaps[0][:2] == (0, len(bomb))
