"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns only near hits, embedded checksums.

One automaton over all keywords runs through the ASCII-lowered bytes of a text. A pattern is
tried only where one of its keywords begins, anchored there, and never inside the previous match
of its kind, which gives the leftmost non-overlapping matches of a plain search. The one kind
without a keyword (long hexadecimal runs) is a single character-class search. Kinds with an
embedded checksum are kept only if it holds.

Defined cases: a NULL or empty text has no span; offsets are code points (end exclusive) of the
whole text; repeated rows give repeated results; an empty table gives no rows; a text of any
length is scanned whole. Matches too short for their kind are dropped but still consume their text.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from cohortspark.llm.common import map_batches, text_bytes

# fixed values: kinds in report order, their keywords (lower case) and patterns
ASSIGN = re.compile(
    rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]+")
NPM = re.compile(rb"npm_[A-Za-z0-9]+")
AGE = re.compile(rb"AGE-SECRET-KEY-1[A-Z0-9]+")
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
    "age": ["age-secret-key-1"],
}
KINDS = ["assign", "access", "hex", "github", "npm", "age"]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def crc_base62_ok(body: bytes) -> bool:
    """30 characters followed by their CRC-32 in six base-62 digits."""
    if len(body) != 36:
        return False
    value, digits = zlib.crc32(body[:30]), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits.encode() == body[30:]


def bech32_ok(text: bytes) -> bool:
    """Bech32 checksum over prefix and data of one word (BIP 173)."""
    head, _, data = text.decode().lower().rpartition("1")
    if len(data) < 6 or any(c not in BECH32 for c in data):
        return False
    values = [ord(c) >> 5 for c in head] + [0] + [ord(c) & 31 for c in head] + [BECH32.index(c) for c in data]
    check = 1
    for v in values:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for bit, g in enumerate(BECH32_GENERATOR):
            check ^= g if top >> bit & 1 else 0
    return check == 1


RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 12),
    "access": (ACCESS, lambda m: len(m[0]) >= 18),
    "github": (GITHUB, lambda m: crc_base62_ok(m[0][4:])),
    "npm": (NPM, lambda m: crc_base62_ok(m[0][4:])),
    "age": (AGE, lambda m: bech32_ok(m[0])),
}
_automaton = None


def automaton():
    """The keyword automaton, built once in each Python worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick
        _automaton = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for w in words:
                _automaton.add_word(w, (kind, len(w)))
        _automaton.make_automaton()
    return _automaton


def byte_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start and then kind order."""
    free, found = dict.fromkeys(RULES, 0), []
    for last, (kind, size) in automaton().iter(raw.lower().decode("latin-1")):
        start = last + 1 - size
        if start < free[kind]:
            continue
        pattern, holds = RULES[kind]
        m = pattern.match(raw, start)
        if m:
            free[kind] = m.end()
            if holds(m):
                found.append((start, m.end(), kind))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def spans_of(raw: bytes) -> list[tuple[int, int, str]]:
    """``byte_spans`` in code points."""
    found = byte_spans(raw)
    if not found or raw.isascii():
        return found
    points, at, done = {}, 0, 0
    for p in sorted({x for s in found for x in s[:2]}):
        at += len(raw[done:p].decode("utf-8", "replace"))
        points[p], done = at, p
    return [(points[a], points[b], k) for a, b, k in found]


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``spans`` array<struct<kind, start, end>> over the whole text."""
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"kind": k, "start": a, "end": b} for a, b, k in spans_of(raw)] for raw in text_bytes(batch["text"])]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch["id"], pa.array(rows, kind)], ["id", "spans"])

    src = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    out = map_batches(src, scan, f"id {src.schema['id'].dataType.simpleString()}, "
                                 "spans array<struct<kind: string, start: bigint, end: bigint>>")
    return out.withColumnRenamed("id", id_col)


def joined(spans) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of ``secret_spans``: counts of the base kinds, SHA-256 of the base spans, all spans."""
    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch["spans"].to_pylist()
        base = [[s for s in r if s["kind"] in KINDS[:3]] for r in rows]
        counts = [pa.array([sum(s["kind"] == k for s in b) for b in base], pa.int64()) for k in KINDS[:3]]
        sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
        return pa.RecordBatch.from_arrays(
            [batch["id"], *counts, sha, pa.array([joined(r) for r in rows], pa.string())],
            ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = secret_spans(df, id_col, text_col).withColumnRenamed(id_col, "id")
    kind = found.schema["id"].dataType.simpleString()
    out = map_batches(found, digest, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, "
                                     "base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def redacted(raw: bytes, mark: bytes = b"[SECRET]") -> bytes:
    """The text with every found span (overlapping ones merged) replaced by ``mark``."""
    out, done = [], 0
    for a, b, _ in byte_spans(raw):
        if a >= done:
            out += [raw[done:a], mark]
        done = max(done, b)
    return b"".join(out) + raw[done:] if out else raw


def redact_secrets(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``df`` with secrets in ``text_col`` masked; ``length_col``, where the
    table has it, is set to the new length of changed texts. NULL texts stay NULL."""
    names = df.columns

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch[text_col].cast(pa.binary()).to_pylist()
        new = [None if b is None else redacted(b) for b in old]
        arrays = [batch[c] for c in names]
        arrays[names.index(text_col)] = pa.array(
            [None if b is None else b.decode("utf-8", "replace") for b in new], pa.string())
        if length_col in names:
            kept = batch[length_col].to_pylist()
            sizes = [n if a == b else len(b.decode("utf-8", "replace")) for n, a, b in zip(kept, old, new)]
            arrays[names.index(length_col)] = pa.array(sizes, batch[length_col].type)
        return pa.RecordBatch.from_arrays(arrays, names)

    return map_batches(df, mask, df.schema)
