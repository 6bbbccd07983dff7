"""Hierarchical multi-length packing.

A document's ids (with an end id) are cut into full top-tier windows; what remains is routed to
the smallest tier that holds it. Each tier, longest first, opens a window with its longest piece
and fills the gap with the largest whole pieces of shorter tiers; when none fits, the longest
piece left is cut to close the gap. Windows are therefore exactly full; the few ids that cannot
fill a window are carried to the next packing round and, at the end of a partition, closed as
ever shorter tiers and one padded sequence. The sequences of a round are dealt to step groups of
equal token budget, the longest first to the lightest group (ties by attention cost).

Packing runs inside the scan's partitions: there is no shuffle, a task holds one round of ids
(``round_ids``), and at most one sequence per partition is padded. Sequence ids are
``partition * 2^32 + n``; a task that runs again reads the same split in the same order and
repeats them.

Defined cases: NULL text is an empty document (the end id only); a text that spells a control token gets its id
unless ``control_tokens`` is off; repeated rows and NULL ids are packed row by row; an empty table gives no rows; a text of any length is packed whole; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cohortspark.llm.common import MEMO, ByteBpe, bpe_path, groups_of, text_bytes

TIERS = (1024, 512, 256, 128)
# a piece is (length, document number, start); a sequence is (tier, [pieces])
Piece = tuple[int, int, int]


def take(pool: list[Piece], length: int) -> Piece | None:
    """Remove and return the longest piece of at most ``length`` ids."""
    i = bisect_right(pool, length, key=lambda p: p[0])
    return pool.pop(i - 1) if i else None


def cut_longest(pool: list[Piece], length: int) -> Piece:
    """Cut the first ``length`` ids off the longest piece of the pool."""
    size, doc, start = pool.pop()
    insort(pool, (size - length, doc, start + length))
    return length, doc, start


def pack_round(sizes: dict[int, int], carried: list[Piece], tiers=TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full sequences of the documents ``number -> ids`` and the pieces carried over; and what is left."""
    top, out, pool = tiers[0], [], list(carried)
    for doc, n in sizes.items():
        out += [(top, [(top, doc, lo)]) for lo in range(0, n - n % top, top)]
        if n % top:
            pool.append((n % top, doc, n - n % top))
    pool.sort()
    for i, tier in enumerate(tiers):
        least = tiers[i + 1] if i + 1 < len(tiers) else 0
        while pool and pool[-1][0] > least:
            seq, gap = [pool.pop()], 0
            gap = tier - seq[0][0]
            while gap and pool:
                piece = take(pool, gap) or cut_longest(pool, gap)
                seq.append(piece)
                gap -= piece[0]
            if gap:
                return out, seq
            out.append((tier, seq))
    return out, []


def close(left: list[Piece], tiers=TIERS) -> list[tuple[int, list[Piece]]]:
    """The last pieces of a partition as full windows of ever shorter tiers and one open sequence."""
    out, queue = [], sorted(left, reverse=True)
    for tier in tiers:
        while sum(p[0] for p in queue) >= tier:
            seq, gap = [], tier
            while gap:
                size, doc, start = queue.pop(0)
                seq.append((min(size, gap), doc, start))
                if size > gap:
                    queue.insert(0, (size - gap, doc, start + gap))
                gap -= seq[-1][0]
            out.append((tier, seq))
    return out + ([(tiers[0], queue)] if queue else [])


def step_groups(sequences: list[tuple[int, list[Piece]]], step_ids: int) -> list[int]:
    """Group of each sequence: about ``step_ids`` ids a group, the longest sequences dealt first to the
    group with the fewest ids, then the least attention cost (sum of squared piece lengths)."""
    used = [sum(p[0] for p in seq) for _, seq in sequences]
    cost = [sum(p[0] ** 2 for p in seq) for _, seq in sequences]
    groups = [(0, 0, g) for g in range(max(1, -(-sum(used) // step_ids)))]
    to = [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: (-used[i], -cost[i])):
        ids, work, g = groups[0]
        heapq.heapreplace(groups, (ids + used[i], work + cost[i], g))
        to[i] = g
    return to


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tokenizer: str | None = None,
         tiers: tuple[int, ...] = TIERS, round_ids: int = 1 << 21, step_ids: int = 1 << 16,
         with_ids: bool = False, control_tokens: bool = True, memo: int = MEMO) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier,
    step_group and, if asked for, the piece's ids. A sequence shorter than its tier is padded.
    ``control_tokens`` and ``memo``: see ``ByteBpe``; fewer remembered parts take less memory and more time."""
    path, end = tokenizer or bpe_path(), struct.pack("<I", end_id)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    src = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    id_field = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        docs: dict[int, tuple] = {}   # number -> (id, ids)
        fresh: dict[int, int] = {}
        left: list[Piece] = []
        number = sequences = groups = held = 0
        kind = None

        def rows(packed):
            nonlocal sequences, groups
            cols = {n: [] for n in ["id", *names, "ids"]}
            for (tier, seq), group in zip(packed, step_groups(packed, step_ids)):
                offset = 0
                for size, doc, start in seq:
                    doc_id, ids = docs[doc]
                    part = memoryview(ids)[4 * start:4 * (start + size)]
                    for c, v in zip(cols, (doc_id, start, size, zlib.crc32(part), len(ids) // 4, base + sequences, offset,
                                           tier, base + groups + group, list(part.cast("I")) if with_ids else None)):
                        cols[c].append(v)
                    offset += size
                sequences += 1
            groups += len(packed)
            arrays = [pa.array(cols["id"], kind), *(pa.array(cols[n], pa.int64()) for n in names)]
            if with_ids:
                arrays.append(pa.array(cols["ids"], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, ["id", *names] + ["ids"] * with_ids)

        for batch in batches:
            kind, keys, texts = batch["id"].type, batch["id"].to_pylist(), text_bytes(batch["text"])
            for lo, hi in groups_of(texts, 2 << 20):
                for key, enc in zip(keys[lo:hi], ByteBpe.of(path, control_tokens, memo).encode(texts[lo:hi])):
                    docs[number] = (key, enc + end)
                    fresh[number] = len(enc) // 4 + 1
                    held += fresh[number]
                    number += 1
                if held >= round_ids:
                    packed, left = pack_round(fresh, left, tiers)
                    yield rows(packed)
                    docs = {p[1]: docs[p[1]] for p in left}
                    fresh, held = {}, 0
        packed, left = pack_round(fresh, left, tiers)
        packed += close(left, tiers)
        if packed:
            yield rows(packed)

    schema = f"id {id_field}, " + ", ".join(f"{n} bigint" for n in names) + ", ids array<bigint>" * with_ids
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
