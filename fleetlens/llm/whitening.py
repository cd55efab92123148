"""Operator 11: whitening of embeddings by distributed block matrices.

Entries become whole numbers, x = floor(1024 c) + 100000.  With n vectors and
sums S the centred rows n x - S are whole, so centring loses nothing; they are
n times the centred rows.  They are laid out in blocks of ``ROWS`` rows.  The
scatter matrix is the product of the transposed matrix with itself, the local
eigenvectors of it give the whitening matrix, and the block matrix times that
projects every row.

A plain product of n columns into one block would send all rows to one task.
So every ``GROUP`` blocks of rows are one cell (i, j) of a square grid: in the
left matrix they stand in block column i, in the right one in block column j.
Block (i, j) of the product is then the scatter of this cell's rows alone, each
block is sent to one task only, and the sum over the grid is the whole scatter.

Vectors that are null, hold a null, NaN or infinite entry, or an entry whose x
is no exact double (2^53), are dropped.  All vectors must be of one length: the
most frequent one counts (the longest of equally frequent ones), others and
empty ones are dropped.  Null and repeated ids stay, each row on its own.
Components whose variance is nothing but rounding (under 1e-12 of the largest)
give 0.0 and are left out of ``identity_error``.  A deviation of 2^63 or more
is null.  No vectors, no rows.  Other columns are not read.

The driver holds matrices of d x d numbers, one for each cell in turn, and the
number of rows of each input partition; never rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import ship

from . import common

#: Rows of a block.
ROWS = 1024
#: Blocks of one cell of the grid: what one task multiplies (16 MB at 64 dimensions).
GROUP = 32
COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
NOTHING = 1e-12


def whole_numbers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x array<long>) of the usable vectors."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where("size(v) > 0")
    x = F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT)
    fine = F.forall("v", lambda c: F.coalesce(F.abs(c) < 2.0**53 / SCALE / 2, F.lit(False)))
    rows = rows.where(fine).select("key", x.alias("x"))
    return common.stage(rows.select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("place")), "vectors")


def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows of the most frequent length, and this length."""
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(2).collect()
    if not sizes:
        return rows, 0
    return rows if len(sizes) == 1 else rows.where(F.size("x") == sizes[0]["size"]), sizes[0]["size"]


def located(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``block``: every input partition's rows fill blocks of their own, numbered through."""
    counts = rows.groupBy("part").agg(F.max("place").alias("last")).withColumn("blocks", F.floor(F.col("last") / ROWS) + 1)
    before = F.sum("blocks").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each input partition
    return rows.join(counts.select("part", F.coalesce(before, F.lit(0)).alias("first")), "part").withColumn("block", (F.col("first") + F.floor(F.col("place") / ROWS)).cast("int"))


def blocks(rows: DataFrame, sums: list[int], n: int) -> DataFrame:
    """(block, values binary): the centred rows n x - S of each block, column by column, absent ones 0."""
    ship(rows.sparkSession)
    d = len(sums)

    def run(batches):
        block, held = None, None
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            places = batch.column("place").to_numpy() % ROWS
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            if n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 62:
                centred = (x * n - np.array(sums, np.int64)).astype(np.float64)
            else:
                centred = np.array([[v * n - s for v, s in zip(row, sums, strict=True)] for row in x.tolist()], np.float64)
            for number in np.unique(numbers):
                if number != block:
                    if held is not None:
                        yield packed(block, held)
                    block, held = number, np.zeros((ROWS, d))
                mine = numbers == number
                held[places[mine]] = centred[mine]
        if held is not None:
            yield packed(block, held)

    def packed(block, held):
        return pa.RecordBatch.from_arrays([pa.array([int(block)], pa.int32()), pa.array([held.tobytes(order="F")], pa.binary())], ["block", "values"])

    return rows.select("block", "place", "x").sortWithinPartitions("block", "place").mapInArrow(run, "block int, values binary")


def side_of(n_blocks: int) -> int:
    """Cells along one side of the grid."""
    return math.isqrt(max(0, (n_blocks - 1) // GROUP)) + 1


def grid(parts: DataFrame, d: int, n_blocks: int, first: bool) -> BlockMatrix:
    """The blocks as a matrix; each stands in the block column of its cell's row (``first``) or column.

    A block whose rows lie in two partitions comes twice, with zeros for the
    rows of the other part: products of the two are 0 and their sum is the
    block, so both products below stay right.
    """
    side = side_of(n_blocks)

    def place(row):
        cell = row.block // GROUP
        return (row.block, cell // side if first else cell % side), DenseMatrix(ROWS, d, np.frombuffer(row["values"]))

    return BlockMatrix(parts.rdd.map(place), ROWS, d, n_blocks * ROWS, side * d)


def scatter(parts: DataFrame, d: int, n_blocks: int) -> np.ndarray:
    """The sum of all rows' outer products."""
    product = grid(parts, d, n_blocks, True).transpose().multiply(grid(parts, d, n_blocks, False))
    return product.blocks.map(lambda b: b[1].toArray()).treeReduce(np.add)


def projected(parts: DataFrame, d: int, n_blocks: int, matrix: np.ndarray) -> BlockMatrix:
    """Every row times ``matrix`` (d x k), in the same blocks."""
    side = side_of(n_blocks)
    k = matrix.shape[1]
    copies = parts.sparkSession.sparkContext.parallelize([((i, 0), DenseMatrix(d, k, matrix.ravel(order="F"))) for i in range(side)], min(side, 64))
    return grid(parts, d, n_blocks, True).multiply(BlockMatrix(copies, d, k, side * d, k))


def axes(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh(covariance)
    return np.maximum(values[::-1][:count], 0.0), vectors[:, ::-1][:, :count]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): one row for each usable vector and component."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    rows, d = usable(whole_numbers(vectors, key, vector))
    if not d:
        schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], schema)
    each = rows.select(F.posexplode("x").alias("dim", "x")).groupBy("dim").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("x").alias("n")).collect()  # d rows
    n = each[0]["n"]
    sums = [int(r.s) for r in sorted(each, key=lambda r: r.dim)]
    placed = common.stage(located(rows), "placed")
    parts = common.stage(blocks(placed, sums, n), "blocks")
    n_blocks = parts.agg(F.max("block")).first()[0] + 1

    covariance = scatter(parts, d, n_blocks) / (float(n) ** 3)
    values, vectors_ = axes(covariance, components)
    solid = values > NOTHING * values[0]
    scale = np.where(solid, 1.0 / np.sqrt(np.where(solid, values, 1.0)), 0.0) / n
    projection = projected(parts, d, n_blocks, vectors_ * scale)
    trace = float(np.trace(covariance))
    explained = [float(v) / trace if trace > 0 else 0.0 for v in values]

    flat = projection.blocks.flatMap(lambda b: [(b[0][0], r, row) for r, row in enumerate(b[1].toArray().tolist())])
    white = common.stage(spark.createDataFrame(flat, "block int, row int, w array<double>"), "whitened")
    own = placed.select("key", "block", (F.col("place") % ROWS).cast("int").alias("row"), _deviation(F.col("x"), sums, n).alias("deviation"))
    joined = own.join(white, ["block", "row"])
    error = _identity_error(white, n, solid)
    out = joined.select("key", "deviation", F.posexplode("w").alias("place", "whitened"))
    return out.select(
        F.col("key").alias(key),
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, explained)), F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _deviation(x, sums: list[int], n: int):
    """Sum of (n x - S)^2 in whole numbers."""
    big = "decimal(38,0)"
    total = F.array(*(F.lit(s).cast(big) for s in sums))

    def square(a, s):
        centred = F.try_subtract(F.try_multiply(a.cast(big), F.lit(n).cast(big)), s).cast(big)
        return F.try_multiply(centred, centred).cast(big)

    return F.aggregate(F.zip_with(x, total, square), F.lit(0).cast(big), lambda a, b: F.try_add(a, b).cast(big)).try_cast("long")


def _identity_error(white: DataFrame, n: int, solid: np.ndarray) -> float:
    """The largest entry of the whitened rows' covariance minus the identity; rows of no vector are 0 and add nothing."""
    k = len(solid)
    means = white.agg(*(F.sum(F.get("w", F.lit(i))).alias(f"m{i}") for i in range(k))).first()
    centre = [m / n for m in means]
    pairs = [(i, j) for i in range(k) for j in range(i, k) if solid[i] and solid[j]]
    products = [F.sum(F.get("w", F.lit(i)) * F.get("w", F.lit(j))).alias(f"p{i}_{j}") for i, j in pairs]
    if not pairs:
        return 0.0
    found = white.agg(*products).first()
    return max(abs(found[f"p{i}_{j}"] / n - centre[i] * centre[j] - float(i == j)) for i, j in pairs)
