"""Token ids as byte- or bit-plane files with a chunk index.

``write_ids`` sorts documents by id over range partitions and lets each task stream its ids into
one file: blocks of a fixed number of ids are transposed into planes (byte j, or bit j, of every
id), each plane is compressed with zstandard, and an index at the end of the file names every
chunk and every document. Files are in ascending order of their first document. ``read_ids``
streams the files back, one chunk at a time.

File: ``BPL1``, the compressed planes, the compressed index, then a fixed tail (index offset,
index length, CRC-32 of the index, ``BPL1``). The index is JSON with one entry per chunk
(offset, ids, byte length of each plane) followed by document ids and lengths as 64-bit integers.

A task writes under a name of its own attempt and renames at the end; its input order is total
(id, text; with very many rows of an id: id, hash of the text, text), so a task that runs again writes the same bytes and lost executors change nothing.
Memory per task is one block, one Arrow batch and the file's index.

Defined cases: NULL text is an empty document (the end id only); NULL ids come first; a text that spells a control token
gets its id unless ``control_tokens`` is off; repeated
rows are written each time; an empty table gives no rows; a long text spans as many blocks as it
needs; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import ByteBpe, bpe_path, groups_of, text_bytes, work_path

MAGIC = b"BPL1"
TAIL = struct.Struct("<QQI4s")
BLOCK_IDS = 1 << 16
ROWS_OF_AN_ID = 10_000


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """The planes of a block of uint32 ids: four byte planes or 32 bit planes."""
    cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [np.ascontiguousarray(cells[:, j]).tobytes() for j in range(4)]
    bits = np.unpackbits(cells, axis=1, bitorder="little")
    return [np.packbits(bits[:, j]).tobytes() for j in range(32)]


def from_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    if plane == "byte":
        cells = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        cells = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(cells).view("<u4").reshape(-1)


class PlaneWriter:
    """Streams ids of consecutive documents into one file."""

    def __init__(self, sink, plane: str, block_ids: int, level: int):
        import zstandard
        self.sink, self.plane, self.block = sink, plane, block_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.parts: list[bytes] = []
        self.held = self.total = 0
        self.chunks, self.docs, self.sizes = [], [], []
        self.sink.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.total += len(ids) // 4
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.block:
            data = b"".join(self.parts)
            whole = len(data) // (4 * self.block) * 4 * self.block
            for lo in range(0, whole, 4 * self.block):
                self._chunk(data[lo:lo + 4 * self.block])
            self.parts, self.held = [data[whole:]], len(data) - whole

    def _chunk(self, data: bytes) -> None:
        blobs = [self.zip.compress(p) for p in to_planes(np.frombuffer(data, "<u4"), self.plane)]
        self.chunks.append([self.at, len(data) // 4, [len(b) for b in blobs]])
        for b in blobs:
            self.sink.write(b)
            self.at += len(b)

    def close(self) -> None:
        if self.held:
            self._chunk(b"".join(self.parts))
        head = json.dumps({"plane": self.plane, "chunks": self.chunks, "docs": len(self.docs),
                           "nulls": [i for i, d in enumerate(self.docs) if d is None]}).encode()
        body = np.array([d or 0 for d in self.docs] + self.sizes, dtype="<i8").tobytes()
        index = self.zip.compress(struct.pack("<Q", len(head)) + head + body)
        self.sink.write(index)
        self.sink.write(TAIL.pack(self.at, len(index), zlib.crc32(index), MAGIC))
        self.sink.close()


class PlaneReader:
    """Index and chunks of one file; ``chunk(i)`` reads only that chunk's bytes."""

    def __init__(self, source):
        import zstandard
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.size()
        at, length, crc, magic = TAIL.unpack(source.read_at(TAIL.size, size - TAIL.size))
        index = source.read_at(length, at)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("not a plane file, or its index is damaged")
        raw = self.unzip.decompress(index)
        n = struct.unpack_from("<Q", raw)[0]
        head = json.loads(raw[8:8 + n])
        self.plane, self.chunks, self.nulls = head["plane"], head["chunks"], set(head["nulls"])
        self.docs, self.sizes = np.frombuffer(raw, "<i8", offset=8 + n).reshape(2, head["docs"])

    def chunk(self, i: int) -> np.ndarray:
        at, n, lengths = self.chunks[i]
        data, planes, lo = self.source.read_at(sum(lengths), at), [], 0
        for length in lengths:
            planes.append(self.unzip.decompress(data[lo:lo + length]))
            lo += length
        return from_planes(planes, n, self.plane)

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """(doc_id, its ids as pieces of consecutive chunks), in file order."""
        held, used, nxt = np.empty(0, "<u4"), 0, 0
        for i, (doc, size) in enumerate(zip(self.docs.tolist(), self.sizes.tolist())):
            pieces = []
            while size:
                if used == len(held):
                    held, used, nxt = self.chunk(nxt), 0, nxt + 1
                take = min(size, len(held) - used)
                pieces.append(held[used:used + take])
                used, size = used + take, size - take
            yield None if i in self.nulls else doc, pieces


def write_ids(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
              tokenizer: str | None = None, plane: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3,
              control_tokens: bool = True) -> DataFrame:
    """Encode and write every document into ``folder``; returns the stored list of files
    (part, file, n_docs, n_ids), one row per file, ordered by part. ``control_tokens``: see ``ByteBpe``."""
    path, end = tokenizer or bpe_path(), struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.bpl"
        tmp = posixpath.join(top, f"_attempt-{task.taskAttemptId()}-{name}")
        writer = None
        for batch in batches:
            ids, texts = batch["id"].to_pylist(), text_bytes(batch["text"])
            for lo, hi in groups_of(texts, 4 << 20):
                if writer is None:
                    where.create_dir(top, recursive=True)
                    writer = PlaneWriter(where.open_output_stream(tmp, compression=None), plane, block_ids, level)
                for doc, enc in zip(ids[lo:hi], ByteBpe.of(path, control_tokens).encode(texts[lo:hi])):
                    writer.add(doc, enc + end)
        if writer is not None:
            writer.close()
            where.move(tmp, posixpath.join(top, name))
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "file": [name],
                                              "n_docs": [len(writer.docs)], "n_ids": [writer.total]})

    src = df.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"`{text_col}` AS text")
    # many rows of one id (or without one) go on by a hash of their text, so that they do not share a task; where no id
    # has many rows, the ranges are sampled from the ids alone and no text is read for them
    many = src.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > ROWS_OF_AN_ID)
    order = [F.col("id")] if many.isEmpty() else [F.col("id"), F.xxhash64("text")]
    ranged = src.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    files = posixpath.join(folder, "files")
    ranged.mapInArrow(run, "part bigint, file string, n_docs bigint, n_ids bigint").write.parquet(files)
    return df.sparkSession.read.parquet(files)


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files in ``folder``: doc_id, start (ids before it in all files), n_tokens,
    ids_crc32 and, if asked for, the ids themselves."""
    files = spark.read.parquet(posixpath.join(folder, "files"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row per file
    placed = files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist()):
                rows = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                with where.open_input_file(posixpath.join(top, name)) as source:
                    held = 0
                    for doc, pieces in PlaneReader(source).documents():
                        crc, n = 0, 0
                        for p in pieces:
                            crc, n = zlib.crc32(p.tobytes(), crc), n + len(p)
                        for c, v in zip(rows, (doc, start, n, crc, np.concatenate(pieces) if with_ids else None)):
                            rows[c].append(v)
                        start, held = start + n, held + (n if with_ids else 4)
                        if held > 1 << 20:
                            yield arrow(rows)
                            rows, held = {c: [] for c in rows}, 0
                if rows["doc_id"]:
                    yield arrow(rows)

    def arrow(rows: dict) -> pa.RecordBatch:
        cols = [pa.array(rows[c], pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            cols, names = [*cols, pa.array(rows["ids"], pa.list_(pa.int64()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    n = max(1, files.count())
    return placed.repartition(n).mapInArrow(run, schema)


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Write ``df``'s documents to a new folder of the shared directory and read them back."""
    folder = work_path(df.sparkSession, "bitplane")
    write_ids(df, folder, **options)
    return read_ids(df.sparkSession, folder)
