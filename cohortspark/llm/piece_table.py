"""Fill-in-the-middle rearrangement with piece tables.

A document is a list of descriptors (buffer, start, length) over two immutable buffers: its UTF-8
text and the sentinels. Cutting splits a descriptor at an offset, an arrangement is a permutation
of prefix, middle and suffix with sentinel descriptors in front of each, and nothing of the text is
copied until a descriptor list is written out. To restore, the output is a buffer of its own: it is
cut where the sentinels of its form stand, and the inverse permutation puts the three spans back in
order. Hashes run over the descriptors, one span after the other.

Cuts fall between lines (``[^\\n]*\\n|[^\\n]+``) and depend on nothing but the document's id and
the seed: the first four 8-digit groups h1 to h4 of the hex SHA-256 of ``seed:doc_id``. The prefix
ends after the smaller of h1 % (n + 1) and h2 % (n + 1) lines, the middle after the larger; the
document is rearranged if h3 % 100 < ``fim_rate``, as suffix-prefix-middle if h4 % 100 < ``spm_rate``,
else as prefix-suffix-middle.

One pass without a shuffle; a task holds one Arrow batch and one document's spans.

Defined cases: NULL text is empty; an empty text, or one that contains a sentinel, stays plain
(its prefix_chars and middle_chars are NULL); a NULL id hashes as the empty string, so its rows are
cut alike; repeated rows give repeated results; bytes that are not UTF-8 stay as they are; long
texts are read whole; an empty table gives no rows; ``rearrange`` keeps all other columns, also
those named like this module's own (its own columns are one struct).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from cohortspark.llm.common import text_bytes

SEED, FIM_RATE, SPM_RATE = 7, 100, 50
SENTINELS = ("<P>", "<S>", "<M>")
TEXT, MARKS = 0, 1
# order of prefix (0), middle (1) and suffix (2) in the output of each form
ARRANGED = {"psm": (0, 2, 1), "spm": (2, 0, 1)}


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        """The two descriptors of this span before and from ``at`` bytes on."""
        return Piece(self.buffer, self.start, at), Piece(self.buffer, self.start + at, self.length - at)


@dataclass(frozen=True)
class Marks:
    """The sentinel buffer: prefix, suffix and middle sentinel, one descriptor each."""
    raw: tuple[bytes, bytes, bytes]

    @classmethod
    def of(cls, sentinels) -> Marks:
        return cls(tuple(s.encode() for s in sentinels))

    @property
    def buffer(self) -> bytes:
        return b"".join(self.raw)

    def piece(self, part: int) -> Piece:
        """Descriptor of the sentinel that stands before prefix (0), middle (1) or suffix (2)."""
        i = (0, 2, 1)[part]
        return Piece(MARKS, sum(map(len, self.raw[:i])), len(self.raw[i]))

    def inside(self, text: bytes) -> bool:
        return any(m in text for m in self.raw)


def hashes(seed: int, doc_id) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def line_count(text: bytes) -> int:
    return text.count(b"\n") + (bool(text) and not text.endswith(b"\n"))


def line_end(text: bytes, units: int, start: int = 0) -> int:
    """Offset after ``units`` lines from ``start`` on."""
    at = start
    for _ in range(units):
        at = text.find(b"\n", at) + 1
        if not at:
            return len(text)
    return at


def arrange(parts: list[Piece], form: str, marks: Marks) -> list[Piece]:
    """Prefix, middle and suffix in the order of ``form``, each behind its sentinel."""
    return [p for part in ARRANGED[form] for p in (marks.piece(part), parts[part])]


def parse(output: bytes, form: str, marks: Marks) -> list[Piece]:
    """Descriptors over ``output`` that spell the original text: the output is cut at the sentinels of
    its form, and the inverse permutation orders the spans."""
    rest = Piece(TEXT, 0, len(output))
    if form == "plain":
        return [rest]
    spans = []
    for k, part in enumerate(ARRANGED[form]):
        mark = marks.piece(part).length
        _, rest = rest.cut(mark)
        if k < 2:
            following = marks.raw[(0, 2, 1)[ARRANGED[form][k + 1]]]
            span, rest = rest.cut(output.index(following, rest.start) - rest.start)
        else:
            span = rest
        spans.append(span)
    inverse = sorted(range(3), key=ARRANGED[form].__getitem__)
    return [spans[i] for i in inverse]


def write_out(pieces: list[Piece], buffers) -> bytes:
    return b"".join(buffers[p.buffer][p.start:p.start + p.length] for p in pieces)


def stream_sha256(pieces: list[Piece], buffers) -> str:
    views, digest = [memoryview(b) for b in buffers], hashlib.sha256()
    for p in pieces:
        digest.update(views[p.buffer][p.start:p.start + p.length])
    return digest.hexdigest()


def n_chars(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(raw.decode("utf-8", "replace")) if not raw.isascii() else len(raw)


class Cut(NamedTuple):
    """A document's lines, form, parts (prefix, middle, suffix) and the descriptors of its output."""
    n: int
    form: str
    parts: list[Piece]
    pieces: list[Piece]


def cut_document(doc_id, text: bytes, marks: Marks, seed: int, fim_rate: int, spm_rate: int) -> Cut:
    whole, n = Piece(TEXT, 0, len(text)), line_count(text)
    h1, h2, h3, h4 = hashes(seed, doc_id)
    if not text or h3 % 100 >= fim_rate or marks.inside(text):
        return Cut(n, "plain", [whole], [whole])
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first = line_end(text, a)
    prefix, rest = whole.cut(first)
    middle, suffix = rest.cut(line_end(text, b - a, first) - first)
    form = "spm" if h4 % 100 < spm_rate else "psm"
    return Cut(n, form, [prefix, middle, suffix], arrange([prefix, middle, suffix], form, marks))


def rearrange(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_rate: int = FIM_RATE,
              spm_rate: int = SPM_RATE, sentinels=SENTINELS, into: str = "fim") -> DataFrame:
    """``df`` with a struct column ``into``: n, form, output (the rearranged text) and pieces, the
    descriptors (buffer 0 the text, 1 the sentinels; byte offsets) that spell it."""
    kind = "struct<n:bigint,form:string,output:string,pieces:array<struct<buffer:int,start:bigint,length:bigint>>>"
    arrow = pa.struct([("n", pa.int64()), ("form", pa.string()), ("output", pa.string()),
                       ("pieces", pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])))])
    marks, id_at, text_at = Marks.of(sentinels), df.columns.index(id_col), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(id_at).to_pylist(), text_bytes(batch.column(text_at))):
                c = cut_document(doc, text, marks, seed, fim_rate, spm_rate)
                out.append((c.n, c.form, write_out(c.pieces, (text, marks.buffer)).decode("utf-8", "replace"),
                            [p._asdict() for p in c.pieces]))
            cells = [dict(zip(("n", "form", "output", "pieces"), row)) for row in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, arrow)], [*batch.schema.names, into])

    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"`{into}` {kind}").fields])
    return df.mapInArrow(run, schema)


def restore(df: DataFrame, form_col: str, output_col: str, into: str = "text", sentinels=SENTINELS) -> DataFrame:
    """``df`` with the original text in column ``into``, rebuilt from output and form alone."""
    marks, names = Marks.of(sentinels), df.columns
    form_at, output_at = names.index(form_col), names.index(output_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [write_out(parse(raw, form, marks), (raw,)).decode("utf-8", "replace")
                     for form, raw in zip(batch.column(form_at).to_pylist(), text_bytes(batch.column(output_at)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(f"`{into}` string").fields]))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_rate: int = FIM_RATE,
           spm_rate: int = SPM_RATE, sentinels=SENTINELS) -> DataFrame:
    """Per document the lines, form, lengths, and the SHA-256 of the output and of the text rebuilt from
    that output."""
    src = df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    marks = Marks.of(sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), text_bytes(batch["text"])):
                c = cut_document(doc, text, marks, seed, fim_rate, spm_rate)
                output = write_out(c.pieces, (text, marks.buffer))
                chars = [None, None] if c.form == "plain" else [
                    n_chars(text[p.start:p.start + p.length]) for p in c.parts[:2]]
                rows.append((c.n, c.form, *chars, stream_sha256(c.pieces, (text, marks.buffer)),
                             stream_sha256(parse(output, c.form, marks), (output,))))
            n, form, prefix, middle, out, back = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(out, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
                               "output_sha256 string, restored_sha256 string")


# the contract in SQL: lines as a list, spans as joined slices of it
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
      ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
      ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
n AS (SELECT *, len(lines)::BIGINT AS n FROM l),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
           WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
      array_to_string(lines[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM p"""
