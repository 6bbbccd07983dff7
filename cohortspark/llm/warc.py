"""WARC archives: writer with revisit records, and a salvage reader.

``write_archives`` decides from a narrow (id, digest) table which record of equal payloads is the
response (smallest id) and which revisit it, then writes the pages, spread evenly by id, as
one ``.warc.gz`` file per partition with one gzip member per record.

``read_archives`` reads archives back in parallel, its own and others', and never gives up on a file. A record
of any type is taken if its framing holds (gzip members by their checksum) and so do the digests it
gives: of the block, and of the payload, which in ``application/http`` blocks begins behind the HTTP
head. After a failed check the reader searches for the next place where a whole record passes: a gzip
magic, or a ``WARC/1.`` version line in uncompressed stretches; the bytes passed over become one
quarantined gap in its log. A damaged record costs itself only.

A task writes under a name of its own attempt and renames at the end, in a total order of its
rows, so a task that runs again writes the same bytes. A file is read through a sliding window. Before the
body of an uncompressed record is read, the place where its length says it ends is looked at, and a member is
unzipped no further than its record's length; so memory is one window and one record, whatever is damaged.

Defined cases: NULL payloads are empty; with payloads of fewer than ``min_bytes`` bytes every record
is a response; of repeated rows the first is the response and the others revisit it; a NULL id
sorts last and comes back as NULL; NULL urls become ``urn:``; an empty table writes nothing and
reads no rows; other columns are ignored. Read records of other writers have a NULL page_id; their
payload length is that of the payload, NULL in revisits. Header names count in any case, folded lines belong to the
line before. Payload digests of revisits, requests, metadata and truncated records speak of other bytes and
are not checked; nor are digests of unknown algorithms. A member that holds several records is a gap.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import stored, work_path

GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
DATE = "2020-01-01T00:00:00Z"   # fixed, so that a rewritten file has the same bytes
WINDOW = 1 << 20
HEADER_BYTES = 1 << 16


def digest_text(raw: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, kind: str) -> bytes:
    """One WARC/1.1 record. A revisit carries no payload but its length and digest."""
    body = payload if kind == "response" else b""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {(url or 'urn:').translate({10: ' ', 13: ' '})}", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


@dataclass
class Record:
    offset: int
    length: int
    kind: str
    record_id: str
    page_id: int | None
    url: str | None
    payload_bytes: int | None
    digest: str | None
    refers_to: int | None
    refers_to_id: str | None
    payload: bytes


class Damaged(ValueError):
    pass


class Window:
    """A sliding view of a file: ``data`` holds the bytes from ``start`` on."""

    def __init__(self, source, size: int, width: int):
        self.source, self.size, self.width = source, size, width
        self.start, self.data, self.marks = 0, b"", {}

    def cover(self, at: int, n: int) -> int:
        """Hold at least ``n`` bytes from ``at`` (fewer at the end of the file); where ``at`` lies in ``data``."""
        lo = at - self.start
        if lo < 0 or lo + min(n, self.size - at) > len(self.data):
            kept = self.data[lo:] if 0 <= lo < len(self.data) else b""
            want = min(max(n, self.width), self.size - at)
            self.data = kept + self.source.read_at(want - len(kept), at + len(kept))
            self.start, self.marks, lo = at, {}, 0
        return lo

    def find(self, mark: bytes, at: int) -> int:
        """Place of the first ``mark`` in the held bytes from ``at`` on; the end of the file if there is none."""
        if self.marks.get(mark, -1) < at:
            found = self.data.find(mark, at - self.start)
            self.marks[mark] = self.size if found < 0 else self.start + found
        return self.marks[mark]

    def next_mark(self, at: int) -> int:
        """The next place from ``at`` on where a member or a version line may begin, or the end of the file."""
        while at < self.size:
            self.cover(at, 64)
            end = self.start + len(self.data)
            sure = end if end == self.size else end - len(VERSION) + 1    # a mark may begin in the last bytes
            found = min(self.find(GZIP, at), self.find(VERSION, at))
            if found < sure:
                return found
            at = max(at, sure)
        return self.size


def page_number(value: str | None) -> int | None:
    """The number of this library's own record ids, else None."""
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.isdigit() or number[:1] == "-" and number[1:].isdigit() else None


def header(raw: bytes) -> dict[str, str]:
    """Named fields in lower case; folded lines belong to the one before."""
    out, name = {}, None
    for line in raw.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        field, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line")
        name = field.strip().lower().decode("utf-8", "replace")
        out[name] = value.strip().decode("utf-8", "replace")
    if not out.get("content-length", "").isdigit():
        raise Damaged("no length")
    return out


def header_end(raw: bytes, lo: int, complete: bool) -> int:
    """Where the header that starts at ``lo`` ends; -1 if more bytes are needed."""
    if not VERSION.startswith(raw[lo:lo + len(VERSION)]):
        raise Damaged("no version line")
    end = raw.find(b"\r\n\r\n", lo, lo + HEADER_BYTES)
    if end < 0 and (complete or len(raw) - lo >= HEADER_BYTES):
        raise Damaged("header does not end")
    return end


def without_chunks(body: bytes) -> bytes:
    """The content of a chunked HTTP body."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else 0
        except ValueError:
            return body
        if not size:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        at = end + 4 + size


def digest_of(named: str):
    """A hash object for a labelled digest; None if there is no digest or its algorithm is unknown here."""
    kind = named.partition(":")[0].lower().replace("-", "")
    return hashlib.new(kind) if kind in ("sha1", "sha256", "sha512", "md5") else None


def same_digest(named: str, raw: bytes) -> bool:
    """Whether a labelled digest spells ``raw`` in base32 or hexadecimal."""
    value = named.partition(":")[2].rstrip("=").upper()
    return value in (base64.b32encode(raw).decode().rstrip("="), raw.hex().upper())


def digest_holds(named: str, *contents: bytes) -> bool:
    """Whether a labelled digest is that of one of the contents; one that cannot be computed is not judged."""
    for content in contents:
        total = digest_of(named)
        if total is None:
            return True
        total.update(content)
        if same_digest(named, total.digest()):
            return True
    return False


def checked(head: dict, body: bytes, offset: int, length: int) -> Record:
    """The record, if it names itself and the digests it gives hold: the block's, and the payload's (for
    HTTP messages what follows the HTTP head)."""
    kind, record_id = head.get("warc-type"), head.get("warc-record-id")
    if not kind or not record_id:
        raise Damaged("no type or id")
    block, own = digest_names(head)
    if not digest_holds(block, body):
        raise Damaged("block digest")
    payload, whole = body, [body]
    if head.get("content-type", "").lower().startswith("application/http"):
        top, _, payload = body.partition(b"\r\n\r\n")
        whole = [payload]
        if b"chunked" in top.lower():
            whole.append(without_chunks(payload))
    named = head.get("warc-payload-digest")
    if not digest_holds(own, *whole):
        raise Damaged("payload digest")
    said = head.get("x-payload-length", "")
    size = int(said) if said.isdigit() else None if kind == "revisit" else len(payload)
    if kind == "response" and said and size != len(payload):
        raise Damaged("payload length")
    refers = head.get("warc-refers-to")
    return Record(offset, length, kind, record_id, page_number(record_id), head.get("warc-target-uri"), size,
                  named and named.partition(":")[2], page_number(refers), refers, payload)


def member_at(w: Window, at: int) -> Record:
    """The record of the gzip member at ``at``, unzipped piece by piece."""
    unzip, text, need, pos, step, head, end = zlib.decompressobj(31), bytearray(), None, at, 4096, {}, 0
    while not unzip.eof:
        if pos >= w.size:
            raise Damaged("member is cut short")
        lo = w.cover(pos, 1)
        data = w.data[lo:lo + step]
        pos, step = pos + len(data), min(2 * step, 1 << 18)
        while data and not unzip.eof:
            try:
                text += unzip.decompress(data, 1 << 20)
            except zlib.error as e:
                raise Damaged(str(e)) from e
            data = unzip.unconsumed_tail
            if need is None:
                end = header_end(text, 0, unzip.eof)
                if end >= 0:
                    head = header(bytes(text[:end]))
                    need = end + 8 + int(head["content-length"])
            if need is not None and len(text) > need:
                raise Damaged("more than one record in a member")
    if need is None or len(text) != need or not text.endswith(b"\r\n\r\n"):
        raise Damaged("length does not fit")
    return checked(head, bytes(text[end + 4:need - 4]), at, pos - len(unzip.unused_data) - at)


def digest_names(head: dict) -> tuple[str, str]:
    """The block digest, and the payload digest where it speaks of this record's own bytes; empty if there is none."""
    own = head.get("warc-type") not in ("revisit", "request", "metadata") and "warc-truncated" not in head
    return head.get("warc-block-digest", ""), head.get("warc-payload-digest", "") if own else ""


def stream_holds(w: Window, head: dict, body: int, size: int) -> bool:
    """Whether a body that the window does not hold has the digests of its header, read once in pieces (of chunked
    HTTP bodies only the block's)."""
    block, payload = digest_names(head)
    skip = 0
    if head.get("content-type", "").lower().startswith("application/http"):
        top = w.source.read_at(min(size, HEADER_BYTES), body)
        skip = top.find(b"\r\n\r\n") + 4
        if skip < 4 or b"chunked" in top[:skip].lower():
            payload = ""
    sums = [(named, digest_of(named), lo) for named, lo in ((block, 0), (payload, skip)) if digest_of(named)]
    for lo in range(0, size, w.width):
        piece = w.source.read_at(min(w.width, size - lo), body + lo)
        for _, total, first in sums:
            total.update(piece[max(0, first - lo):])
    return all(same_digest(named, total.digest()) for named, total, _ in sums)


def plain_at(w: Window, at: int) -> Record:
    """The uncompressed record at ``at``. The two empty lines at its end are looked at before its body is read,
    and a body larger than the window is held only if its digests hold."""
    lo = w.cover(at, min(w.width, HEADER_BYTES))
    end = header_end(w.data, lo, w.start + len(w.data) == w.size)
    if end < 0:
        lo = w.cover(at, HEADER_BYTES)
        end = header_end(w.data, lo, True)
    head = header(w.data[lo:end])
    body, size = at + end - lo + 4, int(head["content-length"])
    stop = body + size + 4
    if stop > w.size:
        raise Damaged("body is cut short")
    held = stop <= w.start + len(w.data)
    tail = w.data[stop - 4 - w.start:stop - w.start] if held else w.source.read_at(4, stop - 4)
    if tail != b"\r\n\r\n":
        raise Damaged("length does not fit")
    if size > w.width and not stream_holds(w, head, body, size):
        raise Damaged("digest of a large body")
    content = w.data[body - w.start:stop - 4 - w.start] if held else w.source.read_at(size, body)
    return checked(head, content, at, stop - at)


def record_at(w: Window, at: int) -> Record:
    """The record (gzip member or plain) at ``at``; raises ``Damaged`` if a check fails."""
    lo = w.cover(at, len(VERSION))
    return member_at(w, at) if w.data.startswith(GZIP, lo) else plain_at(w, at)


def salvage(source, size: int, window: int = WINDOW) -> Iterator[Record | tuple[int, int, str]]:
    """Valid records of a file, and (offset, length, reason) of every gap between them."""
    w, at, gap, reason = Window(source, size, window), 0, None, ""
    while at < size:
        try:
            record = record_at(w, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = w.next_mark(at + 1)
            continue
        if gap is not None:
            yield gap, at - gap, reason
            gap = None
        yield record
        at += record.length
    if gap is not None:
        yield gap, size - gap, reason


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write every row as a WARC record into ``folder``; returns the stored list of files
    (part, file, bytes, records)."""
    pages = df.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"CAST(`{url_col}` AS STRING) AS url",
                          f"coalesce(CAST(`{payload_col}` AS BINARY), X'') AS payload")
    digests = pages.select("id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size"))
    keys = stored(digests.groupBy("id", "sha", "size").agg(F.count("*").alias("copies")), "warc-digests")
    # the first id of payloads that occur under several ids; narrow rows, and equal ones already merged
    repeated = keys.filter(F.col("size") >= min_bytes).groupBy("sha").agg(
        F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    roles = keys.join(repeated, "sha", "left").select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), "first", "copies")
    # payloads are shuffled once, evenly by id; only repeated rows go on to the task of their (id, digest)
    placed = pages.withColumn("sha", F.sha1("payload")).join(
        roles, F.col("id").eqNullSafe(F.col("rid")) & (F.col("sha") == F.col("rsha"))).select(
        "id", "url", "payload", "sha", "first", "copies")
    if not keys.filter("copies > 1").isEmpty():
        placed = placed.filter("copies = 1").unionByName(placed.filter("copies > 1").repartition(F.col("id"), F.col("sha")))
    order = [F.col("id").asc_nulls_last(), "sha", "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = pafs.FileSystem.from_uri(folder)
        task, sink, offset, n, before = TaskContext.get(), None, 0, 0, None
        name = f"part-{task.partitionId():06d}.warc.gz"
        tmp = posixpath.join(top, f"_attempt-{task.taskAttemptId()}-{name}")
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("id", "url", "payload", "sha", "first")]
            for page, url, payload, sha, first in zip(*cols):
                again = before == (page, sha) and len(payload) >= min_bytes   # a repeated row
                before = (page, sha)
                kind = "revisit" if again or (first is not None and first != page) else "response"
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                refers = None if kind == "response" else page if first is None else first
                if sink is None:
                    where.create_dir(top, recursive=True)
                    sink = where.open_output_stream(tmp, compression=None)
                zipper = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = zipper.compress(record_bytes(page, url, payload, digest, refers, kind)) + zipper.flush()
                sink.write(member)
                offset, n = offset + len(member), n + 1
        if sink is not None:
            sink.close()
            where.move(tmp, posixpath.join(top, name))
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "file": [name],
                                              "bytes": pa.array([offset], pa.int64()), "records": pa.array([n], pa.int64())})

    files = posixpath.join(folder, "files")
    placed.sortWithinPartitions(*order).mapInArrow(run, "part bigint, file string, bytes bigint, records bigint").write.parquet(files)
    return df.sparkSession.read.parquet(files)


SCHEMA = ("file string, offset bigint, length bigint, status string, reason string, page_id bigint, url string, "
          "payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, refers_to_id string")


def read_archives(spark: SparkSession, folder: str, files: DataFrame | None = None, with_payload: bool = False,
                  window: int = WINDOW) -> DataFrame:
    """Every valid record (status ``ok``) and every quarantined gap (status ``gap``, with its reason) of
    the archives named by ``files`` (column file; the stored list by default), and the payload if asked for."""
    names = (files if files is not None else spark.read.parquet(posixpath.join(folder, "files"))).select("file").distinct()
    kinds = [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("status", pa.string()),
             ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()),
             ("refers_to_id", pa.string())]
    kinds += [("payload", pa.binary())] * with_payload

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["file"].to_pylist():
                path, rows, held = posixpath.join(top, name), [], 0
                with where.open_input_file(path) as source:
                    for x in salvage(source, source.size(), window):
                        if isinstance(x, Record):
                            row = (name, x.offset, x.length, "ok", None, x.page_id, x.url, x.payload_bytes, x.digest, x.kind,
                                   x.refers_to, x.record_id, x.refers_to_id)
                        else:
                            row = (name, x[0], x[1], "gap", x[2], *[None] * 8)
                        if with_payload:
                            row += (x.payload if isinstance(x, Record) else None,)
                            held += len(row[-1] or b"")
                        rows.append(row)
                        held += 200
                        if held > 4 << 20:
                            yield arrow(rows)
                            rows, held = [], 0
                if rows:
                    yield arrow(rows)

    n = max(1, names.count())
    return names.repartition(n).mapInArrow(run, SCHEMA + ", payload binary" * with_payload)


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to a new folder of the shared directory and read the archives back."""
    folder = work_path(df.sparkSession, "warc")
    write_archives(df, folder, **options)
    return read_archives(df.sparkSession, folder)


# the contract in SQL: equal payloads are found by their digest, written in base32 five bits at a time
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(t) AS sha FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM d),
b AS (SELECT DISTINCT sha, unhex(sha)::BIT::VARCHAR AS bits FROM d),
x AS (SELECT sha, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
       + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT + 1)::BIGINT, 1)), '') AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g JOIN x USING (sha)"""
