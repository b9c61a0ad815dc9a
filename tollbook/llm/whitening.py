"""Embedding whitening (PCA) by distributed block matrices.

1. Components become whole numbers; their sums over all rows are exact, and a row's deviation
   from the mean, times n, is a whole number too. Divided by n it is the centred row, so nothing
   is lost however far the mean lies from zero.
2. Centred rows get gapless numbers and become an ``IndexedRowMatrix`` and a ``BlockMatrix`` of
   blocks of a bounded size. The transpose times the matrix is the scatter; the product is split
   along the rows (``splits``), so that no task gets more than a few blocks, and partial products
   of a task are added up before they are moved.
3. The scatter (dimensions x dimensions) is decomposed in the driver by ``eigh``; the matrix of
   leading eigenvectors, each over the root of its eigenvalue, multiplies the ``BlockMatrix``.
4. The product is centred and multiplied with its own transpose by blocks again, and its
   covariance is held against the identity.

Rows and what is read of them are written to the shared folder before they are used twice. The
driver holds sums and matrices of dimensions x dimensions (``MOST_DIMENSIONS``), and names of blocks of ``BLOCK_BYTES``, nothing else that grows.

Results by case: null vectors, empty ones and those with null or non-finite components are
dropped; so are vectors of another length than the most frequent one (of equally frequent
ones, the longest), as they share no covariance; rows with a null id stay, with a null id; repeated rows
count and are returned row by row; equal eigenvalues share a plane in which any orthogonal pair is
right; components are held to +-2^53 after scaling; a deviation that no long holds is null; a component without variance (an eigenvalue of at most
``FLAT`` of the largest) cannot be scaled to one: its ``whitened`` is null, it takes no part in the
identity error, which is null if no component varies, and ``explained`` is 0; an empty table gives no rows; further columns are not read."""

from __future__ import annotations

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollbook.llm.common import parts, staged, table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
BLOCK_BYTES, BLOCKS_AT_ONCE = 2 * 1024 * 1024, 2  # of a block; blocks that a task multiplies
MOST_SPLITS = 8192  # beyond, a task multiplies more blocks: each split moves one matrix of dimensions x dimensions
MOST_DIMENSIONS = 16_384  # a driver can hold and decompose such a scatter
FLAT = 1e-13
WHOLE = "decimal(38,0)"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that take part, as whole numbers."""
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    most = float(1 << 53)
    held = lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double") * SCALE))).cast("long") + SHIFT
    kept = vectors.filter(value.isNotNull() & (F.size(value) > 0) & finite)
    return kept.select(F.col(key).alias("id"), F.transform(value, held).alias("codes"))


def gapless(rows: DataFrame) -> DataFrame:
    """Rows numbered from 0: written with their places in their partitions, then shifted by the rows of the partitions before."""
    rows = staged(rows.withColumn("place", F.monotonically_increasing_id()), "whole-vectors")
    part = F.shiftright("place", 33)
    sizes = sorted(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).collect())  # one row per partition
    firsts, total = [], 0
    for r in sizes:
        firsts.append((r["part"], total - r["first"]))
        total += r["n"]
    shifts = rows.sparkSession.createDataFrame(firsts, "part long, shift long")
    return rows.withColumn("part", part).join(F.broadcast(shifts), "part").withColumn("row", F.col("place") + F.col("shift")).drop("part", "shift", "place")


def sums(rows: DataFrame) -> list[tuple[int, int, int]]:
    """Exact sum, smallest and largest code by dimension."""
    each = rows.select(F.posexplode("codes").alias("at", "x"))
    found = each.groupBy("at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("total"), F.min("x").alias("least"), F.max("x").alias("most"))
    return [(int(r["total"]), r["least"], r["most"]) for r in found.orderBy("at").collect()]


def deviations(rows: DataFrame, n: int) -> DataFrame:
    """Rows with ``away``, n times the deviation from the mean by dimension, and ``deviation``, the sum of its
    squares; in longs where the range of the codes proves that they hold all of it, else in decimals."""
    found = sums(rows)
    fits = sum(max(n * most - total, total - n * least) ** 2 for total, least, most in found) < 1 << 63 and all(n * max(abs(least), abs(most)) < 1 << 63 and abs(total) < 1 << 63 for total, least, most in found)
    kind = "bigint" if fits else WHOLE
    totals, times = F.array(*[F.lit(str(total)).cast(kind) for total, _, _ in found]), F.lit(n).cast(kind if fits else "decimal(18,0)")
    away = F.zip_with("codes", totals, lambda x, total: (x.cast(kind if fits else "decimal(20,0)") * times).cast(kind) - total)
    squares = F.aggregate("away", F.lit(0).cast(kind), lambda s, d: s + d * d) if fits else F.aggregate("away", F.lit(0).cast(kind), lambda s, d: F.try_add(s, F.try_multiply(d, d).cast(kind)).cast(kind))
    return rows.select("id", "row", away.alias("away")).withColumn("deviation", squares)


class Blocks:
    """Rows (``row`` from 0, array ``values``) as a block matrix with one column of blocks."""

    def __init__(self, rows: DataFrame, n: int, width: int):
        self.n, self.width = n, width
        each = max(1, min(n, BLOCK_BYTES // (8 * width)))
        vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").cast("long"), array_to_vector("values").alias("vector")), "vector")
        self.matrix = IndexedRowMatrix(vectors, n, width).toBlockMatrix(each, width)
        self.splits = min(MOST_SPLITS, parts(parts(n, each), BLOCKS_AT_ONCE))

    def scatter(self) -> np.ndarray:
        """Transpose times matrix, over n."""
        turned, plain = self.matrix.transpose(), self.matrix
        # multiply() of Python has no argument for the splits of the middle dimension
        product = BlockMatrix(turned._java_matrix_wrapper.call("multiply", plain._java_matrix_wrapper._java_model, self.splits), self.width, self.width)
        found = product.toLocalMatrix().toArray() / self.n
        return (found + found.T) / 2

    def times(self, right: np.ndarray) -> DataFrame:
        """Rows times a small matrix: ``row`` and ``values``."""
        tall, wide = right.shape
        one = self.matrix._java_matrix_wrapper._sc.parallelize([((0, 0), Matrices.dense(tall, wide, right.flatten(order="F").tolist()))], 1)
        product = self.matrix.multiply(BlockMatrix(one, tall, wide)).toIndexedRowMatrix()
        rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
        return rows.select(F.col("index").alias("row"), vector_to_array("vector").alias("values"))


def identity_error(rows: DataFrame, n: int, width: int) -> float:
    """The largest entry of the covariance of ``values``, centred first, less the identity."""
    each = rows.select(F.posexplode("values").alias("at", "x"))
    means = [r["mean"] for r in each.groupBy("at").agg(F.avg("x").alias("mean")).orderBy("at").collect()]
    centre = F.array(*map(F.lit, means))
    centred = rows.select("row", F.zip_with("values", centre, lambda x, m: x - m).alias("values"))
    return float(np.abs(Blocks(centred, n, width).scatter() - np.eye(width)).max())


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every row that takes part with its leading components, one row each."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    lengths = rows.groupBy(F.size("codes").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], f"`{key}` {vectors.schema[key].dataType.simpleString()}, {SCHEMA}")
    width, n = lengths[0]
    if width > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {width} dimensions: a scatter of at most {MOST_DIMENSIONS} is held in the driver")
    rows = gapless(rows.filter(F.size("codes") == width))
    apart = deviations(rows, n)
    centred = staged(apart.select("id", "row", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.transform("away", lambda d: d.cast("double") / n).alias("values")), "centred")

    blocks = Blocks(centred, n, width)
    covariance = blocks.scatter()
    values, directions = np.linalg.eigh(covariance)
    values, directions = np.maximum(values[::-1], 0), directions[:, ::-1]
    trace, kept = float(np.trace(covariance)), min(components, width)
    varied = int((values[:kept] > FLAT * values[0]).sum()) if values[0] > 0 else 0
    error = None
    if varied:
        white = staged(blocks.times(directions[:, :varied] / np.sqrt(values[:varied])), "whitened")
        error = identity_error(white, n, varied)
        joined = centred.drop("values").join(white, "row")
    else:
        joined = centred.drop("values").withColumn("values", F.expr("cast(array() as array<double>)"))
    share = F.array(*[F.lit(float(v / trace) if trace > 0 else 0.0) for v in values[:kept]])
    named = joined.select(F.col("id").alias(key), "deviation", "values", F.posexplode(share).alias("at", "explained"))
    return named.select(key, (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.try_element_at("values", F.col("at") + 1).alias("whitened"),
                        "explained", F.lit(error).cast("double").alias("identity_error"))


def op13_whitening(spark, sf_dir):
    """All embeddings, whitened."""
    return whiten(table(spark, sf_dir, "embeddings"))
