"""Exact k-nearest neighbours of long vectors (ML9): a pivot index with partial distances.

**Index.** Pivots (at most ``MAX_PIVOTS``) are means of a bounded, hash-chosen sample of donors. Every donor
belongs to the cell of its nearest pivot; the donors of a cell, in order of their distance to the pivot, are
stored as blocks of ``BLOCK`` vectors, each a ring around the pivot (least and greatest distance). Large
cells are dealt out over several tasks before. Only where pivots lie depends on the sample, never the answer.

**Search.** A query first meets the blocks of its nearest cells that hold k donors; the k-th distance D found
there bounds the answer. By the triangle inequality a donor within D of the query lies in a ring within D of
the query's own distance to that pivot, so all other blocks are left out. Inside a block, vectors are turned
into the principal axes of the donors: the distance on the first ``head`` of the axes and the difference of the
remaining lengths bound the distance from below, and only pairs within D are compared in full.

The rings prune where vectors form clusters. Where they do not (long random vectors are all about equally
far from each other), every exact method has to look at every block, and the partial distances still spare most
full ones. ``visited`` reports both.

Blocks are held in shelves, about ``SHELVES`` of them and none of more than ``SHELF`` donors; a shelf has whole cells or a part of a
large one. Queries are packed by the shelf they go to, at most ``QUERIES`` to a pack, and a pack meets a shelf in one row: a query is sent
once to a shelf, not once to each of its blocks, so up to ``SHELVES`` x ``SHELF`` donors the rows sent grow as the table does. In the row
blocks are left out one by one, nearest first, and the k best so far bound the next. NULL vectors, vectors with NULL or NaN and vectors of
another length than the most frequent one have no neighbours and are none. Ties go by donor id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.session import stored

MAX_PIVOTS = 256
SAMPLE = 8_192
BLOCK = 512
QUERIES = 4_096
SHELVES = 48
SHELF = 32_768
MAX_DIMS = 1_024


def _matrix(column, dims: int) -> np.ndarray:
    """The vectors of a list column (or of one list value of concatenated vectors)."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _clean(df: DataFrame, vec: str, dims: int | None) -> tuple[DataFrame, int]:
    """Rows with a usable vector ``x`` (array<double>), and its length."""
    x = F.col("x")
    rows = df.withColumn("x", F.col(vec).cast("array<double>")).where(x.isNotNull()).where(
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)))
    if dims is None:
        size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).limit(1).collect()
        dims = size[0]["d"] if size else 0
    if dims > MAX_DIMS:
        raise ValueError(f"{dims} dimensions, more than {MAX_DIMS}")
    return rows.where(F.size("x") == dims), dims


def principal_axes(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean of the vectors, their axes by falling variance (columns), and their number; one scan."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + dims + dims * dims)
        for batch in batches:
            m = _matrix(batch["x"], dims)
            total[0] += len(m)
            total[1:1 + dims] += m.sum(axis=0)
            total[1 + dims:] += (m.T @ m).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    got = rows.select("x").mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toPandas()
    v = got["v"].to_numpy()
    n = int(v[0])
    mean = v[1:1 + dims] / n
    _, axes = np.linalg.eigh(v[1 + dims:].reshape(dims, dims) / n - np.outer(mean, mean))
    return mean, axes[:, ::-1].copy(), n


def choose_pivots(rows: DataFrame, did: list[str], dims: int, n: int, rounds: int = 6) -> np.ndarray:
    """Means of a hash-chosen sample of at most ``SAMPLE`` vectors, about one per square root of the donors."""
    few = rows.orderBy(F.xxhash64(*did), *did).limit(SAMPLE).select("x").toArrow()
    m = _matrix(few["x"].combine_chunks(), dims)
    p = max(1, min(MAX_PIVOTS, int(math.sqrt(n) / 2), len(m)))
    pivots = m[np.linspace(0, len(m) - 1, p).astype(int)]
    for _ in range(rounds):
        near = _distances(m, pivots).argmin(axis=1)
        pivots = np.array([m[near == j].mean(axis=0) if (near == j).any() else pivots[j] for j in range(p)])
    return pivots


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))


def build_blocks(rows: DataFrame, did: list[str], payload: list[str], dims: int, pivots: np.ndarray) -> DataFrame:
    """The stored blocks: block, cell, n, inner, outer (distances to the pivot), members (ids and payload), x."""
    kept = list(dict.fromkeys([*did, *payload]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch["x"], dims), pivots)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                                             [*batch.schema.names, "cell", "r"])

    src = rows.select(*kept, "x")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    placed = stored(src.mapInArrow(place, ddl + ", cell int, r double"), "vectors-placed")
    counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = F.create_map(*[F.lit(v) for c, n in counts.items() for v in (c, max(1, -(-n // (16 * BLOCK))))]) if counts else F.lit(None)
    dealt = placed.withColumn("share", F.pmod(F.xxhash64(*did), shares[F.col("cell")]).cast("int") if counts else F.lit(0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, None

        def block(t: pa.Table, seq: int) -> pa.RecordBatch:
            members = pa.StructArray.from_arrays([t[c].combine_chunks() for c in kept], kept)
            x, r = t["x"].combine_chunks().flatten(), t["r"].to_numpy()
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq], pa.int64()), pa.array([t["cell"][0].as_py()], pa.int32()), pa.array([len(t)], pa.int32()),
                 pa.array([r.min()]), pa.array([r.max()]), pa.ListArray.from_arrays([0, len(t)], members),
                 pa.ListArray.from_arrays([0, len(x)], x)], ["block", "cell", "n", "inner", "outer", "members", "x"])

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            # rows come by cell and share: a block ends with them, or when it is full
            key = held["cell"].to_numpy().astype(np.int64) << 32 | held["share"].to_numpy()
            ends = [*(np.flatnonzero(np.diff(key)) + 1).tolist()]
            lo = 0
            for hi in [*ends, len(held)]:
                while hi - lo >= BLOCK or (hi in ends and hi > lo):
                    size = min(BLOCK, hi - lo)
                    yield block(held.slice(lo, size), seq)
                    lo, seq = lo + size, seq + 1
            held = held.slice(lo)
        if held is not None and len(held):
            yield block(held, seq)

    inner = ", ".join(f"`{c}`: {src.schema[c].dataType.simpleString()}" for c in kept)
    ordered = dealt.repartition("cell", "share").sortWithinPartitions("cell", "share", "r", *did)
    return stored(ordered.mapInArrow(pack, f"block bigint, cell int, n int, inner double, outer double, members array<struct<{inner}>>, "
                                           "x array<double>"), "vectors-blocks")


def put_on_shelves(blocks: DataFrame, held: np.ndarray) -> tuple[DataFrame, list[list[int]]]:
    """The stored shelves (shelf, blocks) and the shelves of each cell, for cells of ``held`` donors."""
    size = min(SHELF, max(BLOCK, -(-int(held.sum()) // SHELVES)))
    shelves: list[list[int]] = []
    at, free = 0, size
    for n in held.tolist():
        if n > size:            # a large cell: shelves of its own, its blocks dealt out by hash
            at, free = at + (free < size), size
            parts = -(-n // size)
            shelves.append(list(range(at, at + parts)))
            at += parts
        else:
            if n > free:
                at, free = at + 1, size
            shelves.append([at] if n else [])
            free -= n
    first = F.array(*[F.lit(v[0] if v else 0) for v in shelves])
    parts = F.array(*[F.lit(max(1, len(v))) for v in shelves])
    shelf = F.get(first, F.col("cell")) + F.pmod(F.xxhash64("block"), F.get(parts, F.col("cell"))).cast("int")
    block = F.struct("cell", "n", "inner", "outer", "members", "x")
    return stored(blocks.groupBy(shelf.alias("shelf")).agg(F.collect_list(block).alias("blocks")), "vectors-shelves"), shelves


def pack_queries(asked: DataFrame, qid: list[str], dims: int, shelves: list[list[int]], visits) -> DataFrame:
    """A row per shelf and at most ``QUERIES`` of the queries (qid, x, bound) that visit it: shelf, queries."""
    on = np.zeros((len(shelves), 1 + max((v[-1] for v in shelves if v), default=0)), dtype=bool)
    for c, v in enumerate(shelves):
        on[c, v] = True
    fields = [f"`{f.name}`: {f.dataType.simpleString()}" for f in asked.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, QUERIES):
                part = batch.slice(lo, QUERIES)
                rows = pa.StructArray.from_arrays(part.columns, part.schema.names)
                goes = visits(_matrix(part["x"], dims), part["bound"].to_numpy())[0] @ on
                for shelf in np.flatnonzero(goes.any(axis=0)):
                    chosen = rows.take(pa.array(np.flatnonzero(goes[:, shelf])))
                    yield pa.RecordBatch.from_arrays([pa.array([shelf], pa.int32()), pa.ListArray.from_arrays([0, len(chosen)], chosen)],
                                                     ["shelf", "queries"])

    return asked.mapInArrow(run, f"shelf int, queries array<struct<{', '.join(fields)}>>")


def _meet(packs: DataFrame, shelves: DataFrame, qid: list[str], did: list[str], kept: list[str], dims: int, k: int, mean: np.ndarray,
          axes: np.ndarray, head: int, visits) -> DataFrame:
    """The k nearest donors of every query on every shelf it visits, stored: qid, d_<kept>, dist; and per (pack, shelf) one row
    without ids that counts pairs and full comparisons."""
    met = packs.join(shelves, "shelf").select("queries", "blocks")
    q_fields = {f.name: f.dataType for f in packs.schema["queries"].dataType.elementType.fields}
    members = {f.name: f.dataType for f in shelves.schema["blocks"].dataType.elementType.fields}["members"].elementType
    d_fields = {f.name: f.dataType for f in members.fields}
    ddl = ", ".join([f"`{c}` {q_fields[c].simpleString()}" for c in qid]
                    + [f"`d_{c}` {d_fields[c].simpleString()}" for c in kept] + ["dist double", "pairs bigint", "compared bigint"])
    names = [*qid, *[f"d_{c}" for c in kept], "dist", "pairs", "compared"]

    def best(a: np.ndarray, dist: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the k best of each query (ties: the least donor id), and the distance of the kth."""
        order = np.lexsort((place, dist, a))
        a = a[order]
        nth = np.arange(len(a)) - np.searchsorted(a, np.arange(n))[a]
        at_k = np.full(n, np.inf)
        at_k[a[nth == k - 1]] = dist[order[nth == k - 1]]
        return order[nth < k], at_k

    def distances(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of the pairs (q[a], x[b]), a bounded number at a time."""
        step = 1 << 16
        return np.concatenate([np.empty(0), *[np.sqrt(((q[a[i:i + step]] - x[b[i:i + step]]) ** 2).sum(axis=1)) for i in range(0, len(a), step)]])

    def one(queries: pa.StructArray, blocks: pa.StructArray) -> Iterator[pa.RecordBatch]:
        q = _matrix(queries.field("x"), dims)
        bound = queries.field("bound").to_numpy()
        cells, inner, outer = (blocks.field(c).to_numpy() for c in ("cell", "inner", "outer"))
        allowed, far, slacks = visits(q, bound)
        zq = (q - mean) @ axes
        q_tail, q_size = np.sqrt((zq[:, head:] ** 2).sum(axis=1)), (zq**2).sum(axis=1)
        q_low = (zq[:, :head] ** 2).sum(axis=1)
        at, dist = np.empty(0, np.int64), np.empty(0)
        lists = [blocks.field("members")[i].values for i in range(len(blocks))]
        starts = np.cumsum([0, *[len(m) for m in lists]])
        donors = pa.concat_arrays(lists)
        ids = pa.Table.from_arrays([donors.field(c) for c in did], did)
        place = np.empty(len(donors), np.int64)         # of each donor in the order of the ids
        place[pc.sort_indices(ids, sort_keys=[(c, "ascending") for c in did], null_placement="at_start").to_numpy()] = np.arange(len(donors))
        found, pairs, compared = np.empty(0, np.int64), 0, 0
        limit = bound.copy()
        for i in np.argsort(far[:, cells].mean(axis=0), kind="stable"):
            x = blocks.field("x")[int(i)].values.to_numpy().reshape(-1, dims)
            d, slack = far[:, cells[i]], slacks[:, cells[i]]
            sel = np.flatnonzero(allowed[:, cells[i]] & (d - outer[i] - slack <= limit) & (inner[i] - d - slack <= limit))
            if not len(sel):
                continue
            zx = (x - mean) @ axes
            tail = q_tail[sel][:, None] - np.sqrt((zx[:, head:] ** 2).sum(axis=1))
            size = q_size[sel][:, None] + (zx**2).sum(axis=1)
            low = q_low[sel][:, None] + (zx[:, :head] ** 2).sum(axis=1) - 2 * zq[sel, :head] @ zx[:, :head].T + tail**2
            a, b = np.nonzero(low - 1e-9 * size <= (limit[sel] ** 2)[:, None])
            pairs, compared = pairs + len(sel) * len(x), compared + len(a)
            a = sel[a]
            at = np.concatenate([at, a])
            dist = np.concatenate([dist, distances(q, x, a, b)])
            found = np.concatenate([found, starts[i] + b])
            keep, at_k = best(at, dist, place[found], len(q))
            at, dist, found = at[keep], dist[keep], found[keep]
            limit = np.minimum(bound, at_k)
        if len(at):
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([*[queries.field(c).take(pa.array(at)) for c in qid],
                                              *[donors.field(c).take(pa.array(found)) for c in kept], pa.array(dist), none, none], names)
        counted = [pa.nulls(1, queries.field(c).type) for c in qid] + [pa.nulls(1, lists[0].field(c).type) for c in kept]
        yield pa.RecordBatch.from_arrays([*counted, pa.nulls(1, pa.float64()), pa.array([pairs]), pa.array([compared])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from one(batch["queries"][i].values, batch["blocks"][i].values)

    return stored(met.mapInArrow(run, ddl), "vectors-met")


def vector_knn(queries: DataFrame, donors: DataFrame, qid: list[str], did: list[str], vec: str, k: int, payload: list[str] | None = None,
               head: float = 0.75, visited: dict | None = None) -> DataFrame:
    """The k nearest donors of every query by Euclidean distance, exactly: qid, d_<did>, d_<payload>, dist, nn_rank. ``visited``
    receives all (query, donor) pairs, those in visited blocks, and those compared in full."""
    payload = payload or []
    kept = list(dict.fromkeys([*did, *payload]))
    rows, dims = _clean(donors, vec, None)
    asked, _ = _clean(queries, vec, dims)
    asked = stored(asked.select(*qid, "x"), "vectors-queries")
    n_queries = asked.count()
    if not dims:
        none = asked.select(*qid).limit(0).join(donors.select(*[F.col(c).alias(f"d_{c}") for c in kept]).limit(0))
        return none.withColumns({"dist": F.lit(0.0), "nn_rank": F.lit(1)})
    mean, axes, n = principal_axes(rows, dims)
    pivots = choose_pivots(rows, did, dims, n)
    blocks = build_blocks(rows, did, payload, dims, pivots)
    cells = {r["cell"]: r for r in blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.min("inner").alias("inner"), F.max("outer").alias("outer")).collect()}
    held = np.array([cells[j]["n"] if j in cells else 0 for j in range(len(pivots))])
    inner = np.array([cells[j]["inner"] if j in cells else np.inf for j in range(len(pivots))])
    outer = np.array([cells[j]["outer"] if j in cells else -np.inf for j in range(len(pivots))])
    shelves, places = put_on_shelves(blocks, held)

    pivot_size = np.sqrt((pivots**2).sum(axis=1)) + np.maximum(outer, 0)

    def visits(nearest: bool):
        """Which cells each query has to visit, its distance to their pivots, and the slack of that: the nearest ones with
        k donors, or all whose rings come within its bound. ``_distances`` takes squares from each other, so a short
        distance between long vectors is known to some 1e-8 of their length, and differs by batch."""
        def run(x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            d = _distances(x, pivots)
            slack = 1e-9 * (d + 1) + 2e-7 * (np.sqrt((x**2).sum(axis=1))[:, None] + pivot_size)
            if nearest:
                order = np.argsort(d, axis=1, kind="stable")
                before = np.cumsum(held[order], axis=1) - held[order]
                go = np.zeros(d.shape, dtype=bool)
                np.put_along_axis(go, order, (before < k) & (held[order] > 0), axis=1)
                return go, d, slack
            return (d - outer - slack <= bound[:, None]) & (inner - d - slack <= bound[:, None]), d, slack
        return run

    def meet(rows: DataFrame, nearest: bool) -> DataFrame:
        which = visits(nearest)
        packs = pack_queries(rows.select(*qid, "x", "bound"), qid, dims, places, which)
        return _meet(packs, shelves, qid, did, kept, dims, k, mean, axes, round(head * dims), which)

    found = meet(asked.withColumn("bound", F.lit(float("inf"))), True)
    mine = Window.partitionBy(*qid)
    rank = F.row_number().over(mine.orderBy("dist", *[F.col(f"d_{c}") for c in did]))
    best = found.where("dist IS NOT NULL").withColumn("nn_rank", rank).where(F.col("nn_rank") <= k)
    reach = best.groupBy(*qid).agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("bound"))
    bounded = stored(asked.join(reach, qid), "vectors-bounded")
    final = meet(bounded, False)
    if visited is not None:
        sums = final.agg(F.sum("pairs").alias("p"), F.sum("compared").alias("c")).first()
        visited.update(all_pairs=n_queries * n, pairs=sums["p"] or 0, compared=sums["c"] or 0)
    return final.where("dist IS NOT NULL").withColumn("nn_rank", rank).where(F.col("nn_rank") <= k).select(
        *qid, *[f"d_{c}" for c in kept], "dist", "nn_rank")
