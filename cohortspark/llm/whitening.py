"""Embedding whitening with Spark MLlib's ``BlockMatrix``.

Vectors are quantised to integers (``floor(64 * c) + 1000000``), so that sums, means and deviations are
exact. The fit list holds each distinct vector once. Its rows, centred, are indexed into blocks of
``rows_per_block`` rows, ``A``; the scatter matrix is ``A.transpose().multiply(A)``, its eigenvectors come from a
local ``eigh`` of that dims x dims matrix, and ``A.multiply(W)`` with the whitening matrix projects the rows of all
vectors. The identity error is measured on the projected fit list: its own covariance, once more as
a product of blocks.

Every step reads a stored table with one row per block, numbered from the counts of its writing tasks. A
product of blocks lists its block numbers on the driver, so tables of more than ``SLAB_BLOCKS`` blocks are
multiplied slab by slab: scatter matrices are added up, projections written one after the other. The product
behind the scatter is split along the rows over many tasks (``multiply``'s third operand in
Spark's own API), so no task holds more than its share of blocks and one dims x dims sum.

Defined cases: vectors that are NULL, empty, or hold NULL, NaN or infinite entries are dropped, and so are vectors
of another length than the most frequent one (of equally frequent ones the longest); NULL ids and repeated rows
are kept, each with its own rows; ``64 * c`` saturates at 2^52 either way; components whose
eigenvalue is below 1e-12 of the largest do not exist (one distinct vector alone: no rows); of equal
eigenvalues any basis is taken; an empty table gives no rows; other columns are ignored. The deviation is a
decimal(38,0), exact; NULL if it had more digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cohortspark.llm.common import stored, work_path

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 52
COMPONENTS = 16
MAX_DIMS = 4096
BLOCK_VALUES = 1 << 16      # entries of a block, about
SLAB_BLOCKS = 4096
RANK_TOLERANCE = 1e-12

BLOCK_SCHEMA = StructType([
    StructField("index", StructType([StructField("row", LongType()), StructField("col", LongType())])),
    StructField("matrix", MatrixUDT())])
# Arrow form of one dense block: MatrixUDT's own fields
DENSE = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
                   ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])


def quantised(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """vec_id and x (array<bigint>) of the rows that count, all of one length, and that length."""
    c = F.col("v")
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = (df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter(c.isNotNull() & (F.size(c) > 0)).filter(finite))
    lengths = rows.groupBy(F.size(c).alias("d")).count()
    best = lengths.orderBy(F.col("count").desc(), F.col("d").desc()).limit(1).collect()
    dims = best[0].d if best else 0
    if dims > MAX_DIMS:
        raise ValueError(f"{dims} dimensions; the local eigenproblem is bounded by {MAX_DIMS}")
    most = F.lit(float(LARGEST))
    x = F.transform(c, lambda e: F.floor(F.greatest(-most, F.least(most, e * float(SCALE)))) + F.lit(SHIFT))
    return rows.filter(F.size(c) == dims).select("vec_id", x.alias("x")), dims


def blocked(rows: DataFrame, name: str, rows_per_block: int) -> tuple[DataFrame, int]:
    """``rows`` (vec_id, x) as a stored table of blocks (block, ids, x: the values row by row), numbered without gaps,
    and the number of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def out(table: pa.Table, seq: int) -> pa.RecordBatch:
            values = pa.concat_arrays([c.flatten() for c in table["x"].chunks])
            ids = pa.concat_arrays(table["vec_id"].chunks)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int64()),
                 pa.ListArray.from_arrays([0, len(ids)], ids), pa.ListArray.from_arrays([0, len(values)], values)],
                ["part", "seq", "ids", "x"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= rows_per_block:
                table = pa.Table.from_batches(held)
                yield out(table.slice(0, rows_per_block), seq)
                rest = table.slice(rows_per_block)
                seq, held = seq + 1, rest.to_batches() if rest.num_rows else []
        if held and sum(b.num_rows for b in held):
            yield out(pa.Table.from_batches(held), seq)

    kind = rows.schema["vec_id"].dataType.simpleString()
    table = stored(rows.mapInArrow(run, f"part bigint, seq bigint, ids array<{kind}>, x array<bigint>"), name)
    tasks = table.groupBy("part").agg(F.count("*").alias("blocks"))
    before = F.sum("blocks").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))   # one row per task
    first = tasks.select("part", "blocks", F.coalesce(before, F.lit(0)).alias("first"))
    total = tasks.agg(F.sum("blocks")).first()[0] or 0
    return table.join(first.select("part", "first"), "part").select((F.col("first") + F.col("seq")).alias("block"), "ids", "x"), total


def sums(blocks: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows and exact per-dimension sums of a table of integer blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in batch["x"]:
                m = values.values.to_numpy().reshape(-1, dims)
                # in two halves, so that no sum of a block can overflow
                high, low = (m >> 32).sum(axis=0), (m & 0xFFFFFFFF).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, len(m))), pa.array(high), pa.array(low)],
                                                 ["dim", "n", "high", "low"])

    part = blocks.select("x").mapInArrow(run, "dim bigint, n bigint, high bigint, low bigint")
    got = part.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("dim").collect()
    return (got[0].n if got else 0), [r.high * (1 << 32) + r.low for r in got]


def centred(m: np.ndarray, n: int, total: list) -> np.ndarray:
    """m - total / n by column; integers are centred by the floor of the mean first, which is exact."""
    if m.dtype.kind == "i":
        whole = np.array([t // n for t in total], dtype=np.int64)
        return (m - whole) - np.array([(t % n) / n for t in total])
    return m - np.array(total) / n


def block_matrix(blocks: DataFrame, column: str, dims: int, n: int, total: list, first: int, count: int, rows_per_block: int) -> BlockMatrix:
    """The centred rows of blocks ``first`` to ``first + count - 1`` as a ``BlockMatrix``; short blocks end in rows of zeros."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, values in zip(batch["block"].to_pylist(), batch[column]):
                m = np.zeros((rows_per_block, dims))
                part = centred(values.values.to_numpy().reshape(-1, dims), n, total)
                m[:len(part)] = part
                cell = pa.StructArray.from_arrays(
                    [pa.array([1], pa.int8()), pa.array([rows_per_block], pa.int32()), pa.array([dims], pa.int32()),
                     pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())),
                     pa.ListArray.from_arrays([0, m.size], pa.array(m.ravel())), pa.array([True])], fields=list(DENSE))
                index = pa.StructArray.from_arrays([pa.array([block - first], pa.int64()), pa.array([0], pa.int64())], ["row", "col"])
                yield pa.RecordBatch.from_arrays([index, cell], ["index", "matrix"])

    slab = blocks.filter((F.col("block") >= first) & (F.col("block") < first + count)).select("block", column)
    found = slab.mapInArrow(run, BLOCK_SCHEMA)
    made = callMLlibFunc("createBlockMatrix", found, rows_per_block, dims, count * rows_per_block, dims)
    return BlockMatrix(made, rows_per_block, dims)


def slabs(total_blocks: int) -> Iterator[tuple[int, int]]:
    for first in range(0, total_blocks, SLAB_BLOCKS):
        yield first, min(SLAB_BLOCKS, total_blocks - first)


def scatter(blocks: DataFrame, column: str, dims: int, n: int, total: list, total_blocks: int, rows_per_block: int) -> np.ndarray:
    """Transpose times matrix of the centred rows."""
    out = np.zeros((dims, dims))
    for first, count in slabs(total_blocks):
        a = block_matrix(blocks, column, dims, n, total, first, count, rows_per_block)
        # the product is a single block, a sum over all row blocks: split over tasks of at most 64 row blocks
        splits = min(count, max(count // 64, 2 * blocks.sparkSession.sparkContext.defaultParallelism))
        product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
        out += BlockMatrix(product, dims, dims).toLocalMatrix().toArray()
    return out


def project(blocks: DataFrame, dims: int, n: int, total: list, total_blocks: int, rows_per_block: int, w: np.ndarray, name: str) -> DataFrame:
    """(block, z: the projected rows of the block, row by row) as a stored table."""
    spark: SparkSession = blocks.sparkSession
    path, k = work_path(spark, name), w.shape[1]
    local = spark.sparkContext.parallelize([((0, 0), DenseMatrix(dims, k, w.ravel(order="F")))], 1)
    whitening = BlockMatrix(local, dims, k, dims, k)
    schema = StructType.fromDDL("block bigint, z array<double>")
    spark.createDataFrame([], schema).write.parquet(path)
    for first, count in slabs(total_blocks):
        product = block_matrix(blocks, "x", dims, n, total, first, count, rows_per_block).multiply(whitening)
        cells = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model)

        def run(batches: Iterator[pa.RecordBatch], first=first) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for index, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                    rows, cols = cell["numRows"].as_py(), cell["numCols"].as_py()
                    z = cell["values"].values.to_numpy()
                    z = z.reshape(rows, cols) if cell["isTransposed"].as_py() else z.reshape(cols, rows).T
                    flat = np.ascontiguousarray(z).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([first + next(iter(index.values()))], pa.int64()),
                                                      pa.ListArray.from_arrays([0, len(flat)], pa.array(flat))], ["block", "z"])

        cells.mapInArrow(run, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def mean_of(values: DataFrame, k: int) -> list[float]:
    """Sum over the rows of each column of projected blocks (padding rows are left out before)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z in batch["z"]:
                m = z.values.to_numpy().reshape(-1, k).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(m)], ["dim", "total"])

    got = values.select("z").mapInArrow(run, "dim bigint, total double").groupBy("dim").agg(F.sum("total").alias("total"))
    return [r.total for r in got.orderBy("dim").collect()]


def without_padding(projected: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The projected blocks with as many rows as the block has, beside the block's ids and vectors."""
    return blocks.join(projected, "block").withColumn("z", F.expr(f"slice(z, 1, size(ids) * {k})"))


def deviations(m: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - total)^2, exact, a value per row."""
    whole, rest = np.array([t // n for t in total], dtype=np.int64), [t % n for t in total]
    d = m - whole
    top = int(np.abs(d).max(initial=0)) + 1
    if m.shape[1] * (n * top) ** 2 < 2**63:
        d = d * n - np.array(rest, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    return [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in d.tolist()]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    rows, dims = quantised(df, id_col, vector_col)
    id_kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {id_kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    if not dims:
        return df.sparkSession.createDataFrame([], schema)
    per_block = max(16, BLOCK_VALUES // dims)
    everything, n_blocks = blocked(rows, "whitening-rows", per_block)
    distinct = rows.groupBy("x").agg(F.lit(None).cast(id_kind).alias("vec_id")).select("vec_id", "x")
    fit, fit_blocks = blocked(distinct, "whitening-fit", per_block)
    n, total = sums(fit, dims)

    covariance = scatter(fit, "x", dims, n, total, fit_blocks, per_block) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values, kind="stable")[::-1][:components]
    order = [j for j in order if values[j] > RANK_TOLERANCE * max(values.max(), 0.0)]
    k = len(order)
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    w = vectors[:, order] / np.sqrt(values[order])
    explained = (values[order] / np.trace(covariance)).tolist()

    z_fit = stored(without_padding(project(fit, dims, n, total, fit_blocks, per_block, w, "whitening-fit-projected"), fit, k)
                   .select("block", "z"), "whitening-fit-z")
    gram = scatter(z_fit, "z", k, n, mean_of(z_fit, k), fit_blocks, per_block) / n
    identity_error = float(np.abs(gram - np.eye(k)).max())

    projected = project(everything, dims, n, total, n_blocks, per_block, w, "whitening-projected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, z in zip(batch["ids"], batch["x"], batch["z"]):
                dev = deviations(x.values.to_numpy().reshape(-1, dims), n, total)
                dev = [Decimal(v) if v < 10**38 else None for v in dev]
                at = np.repeat(np.arange(len(dev)), k)
                size = len(at)
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(dev))),
                     pa.array(np.full(size, n)), pa.array(dev, pa.decimal128(38, 0)).take(pa.array(at)), pa.array(z.values.to_numpy()),
                     pa.array(np.tile(explained, len(dev))), pa.array(np.full(size, identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return without_padding(projected, everything, k).mapInArrow(run, schema)

