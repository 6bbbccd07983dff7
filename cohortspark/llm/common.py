"""Helpers shared by the training-data operators: tables, work folders, words, byte-BPE ids.

Words are runs of anything but ASCII white space (``[^\\x20\\x09-\\x0D]+``). NULL texts count as empty.
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortspark.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder name for one run under the shared folder of ``spark.checkpoint.dir``."""
    return posixpath.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends at
    files that survive lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of one batch. Spark bounds a batch by
    ``spark.sql.execution.arrow.maxBytesPerBatch`` and ``maxRecordsPerBatch``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside: a worker and its executor hold a batch and what is
    made of it, several at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    most = int(before)
    spark.conf.set(name, str(rows if most <= 0 else min(most, rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; NULL is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def groups_of(items: list[bytes], limit: int, most: int = 1 << 14) -> Iterator[tuple[int, int]]:
    """Consecutive slices of about ``limit`` bytes and at most ``most`` items; a longer item is a slice of
    its own."""
    start = total = 0
    for i, b in enumerate(items):
        if i > start and (total + len(b) > limit or i - start == most):
            yield start, i
            start, total = i, 0
        total += len(b)
    if start < len(items):
        yield start, len(items)


def mix64(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (three xor-shifts, two odd multipliers) over an array of uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# a single space between two characters that are not white space starts a new BPE piece
_JOINT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")
# Latin letters, then ASCII marks: two pieces of the vocabulary's pattern, whatever the letters and marks
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable bytes stand for themselves, the
    others for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class _Memo(dict):
    """part -> ids; an unknown part is learned when it is first asked for."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = self.learn(part)
        return ids


MEMO = 1_200_000      # parts that a worker remembers, some 250 MB


class ByteBpe:
    """Ids of a ``tokenizers`` file, for byte-level BPE with a bounded memo of words.

    The vocabulary's pattern always starts a new piece at a single space between two non-space
    characters, so a text may be cut there and each part encoded by itself: the ids are those of
    the whole text (tested). Unknown parts of Latin letters and marks go to the BPE model as the
    two pieces they are, all others to ``encode_batch``. The memo starts anew between texts once it
    holds more than ``memo`` parts. Tokenizers of another kind encode whole texts. One instance per Python
    worker, file and setting.

    ``control_tokens``: whether a text that spells a control token of the file (``<|endoftext|>``) gets that token's id,
    as the tokenizers library does by default; without it such a text gets the ids of its characters, so that
    no document can write control tokens into a corpus.
    """

    _open: dict[tuple[str, bool, int], ByteBpe] = {}

    def __init__(self, path: str, memo: int = MEMO, control_tokens: bool = True):
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not control_tokens
        kind = json.loads(self.tok.to_str())
        pre = kind.get("pre_tokenizer") or {}
        # control tokens are found before the text is cut into pieces; they must not reach over a space
        added = [t for t in kind.get("added_tokens") or [] if control_tokens or not t.get("special")]
        self.added = [t["content"] for t in added]
        inside = all(not any(c.isspace() for c in t["content"]) and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in added)
        self.cuts = (kind["model"].get("type") == "BPE" and kind.get("normalizer") is None and pre.get("type") == "ByteLevel"
                     and not pre.get("add_prefix_space") and pre.get("use_regex", True) and inside)
        self.letters = byte_letters()
        self.memo, self.limit, self.tails = _Memo(self.learn), memo, {}

    @classmethod
    def of(cls, path: str, control_tokens: bool = True, memo: int = MEMO) -> ByteBpe:
        key = (path, control_tokens, memo)
        if key not in cls._open:
            cls._open[key] = cls(path, memo, control_tokens)
        return cls._open[key]

    @staticmethod
    def parts(text: str) -> list[str]:
        """The text cut before every single inner space; all parts but the first lost that space."""
        if ("  " in text or "\n " in text or " \n" in text or text.startswith(" ") or text.endswith(" ")
                or _OTHER_SPACE.search(text)):
            return _JOINT.split(text)
        return text.split(" ")

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def learn(self, part: str) -> bytes:
        """Ids of a space and an unknown part."""
        m = _PLAIN.fullmatch(part)
        if not m or any(t in part for t in self.added):
            return self._plain([" " + part])[0]
        word, marks = m.groups()
        if marks:
            if marks not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                self.tails[marks] = self._plain([marks])[0]
            return self.memo[word] + self.tails[marks]
        raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tok.model.tokenize(self.letters[32] + raw)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit bytes."""
        out = []
        for lo, hi in groups_of(texts, 1 << 18):
            whole = [b.decode("utf-8", "replace") for b in texts[lo:hi]]
            if not self.cuts:
                out += self._plain(whole)
                continue
            if len(self.memo) > self.limit:
                self.memo.clear()
            cut = [self.parts(t) for t in whole]
            get = self.memo.__getitem__
            out += [h + b"".join(map(get, p[1:])) for h, p in zip(self._plain([p[0] for p in cut]), cut)]
        return out


def bpe_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file; every executor has the package."""
    import public_tokenizers
    return public_tokenizers.path(name)


def n_words(column) -> F.Column:
    """Number of words of a text column as long (NULL: 0)."""
    return F.coalesce(F.size(F.regexp_extract_all(column, F.lit(f"({WORD})"))), F.lit(0)).cast("long")
