"""Whitening of embeddings with MLlib's BlockMatrix.

Centred rows become blocks; transpose times blocks is the scatter, its
eigenvectors come from the local eigh of a dims x dims matrix, and blocks
times the whitening matrix are the projected rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm.common import ship, written
from varve.llm.vectors import finite, length_of

#: Rows of a block at most. MLlib keeps the coordinates of all blocks in the driver.
BLOCK_ROWS = 4096

_PLACES = (1 << 33) - 1


@dataclass(frozen=True)
class Whitening:
    """Of the fit list: rows, sums by dimension, eigenvalues (falling) and eigenvectors (columns), and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def centred(self, x: Column) -> Column:
        """x - S / n, where n * x - S is exact."""
        return F.zip_with(x, F.lit(self.sums), lambda c, s: (c * F.lit(self.n).cast("long") - s).cast("double") / float(self.n))

    def deviation(self, x: Column) -> Column:
        """The sum of (n * x - S) ** 2, exact; a sum beyond 64 bits is an error."""
        off = F.zip_with(x, F.lit(self.sums), lambda c, s: c * F.lit(self.n).cast("long") - s)
        return F.aggregate(off, F.lit(0).cast("long"), lambda total, d: total + d * d)


def placed(rows: DataFrame) -> tuple[DataFrame, int, int, int]:
    """(rows with `index`, rows, rows of a block, parts): a place in a matrix for every row.

    A partition owns whole blocks, so no partition has to know how many rows
    the others have; places it doesn't fill are rows of zeros. The table is
    written with its places, hence they stay as they are.
    """
    table = written(rows.withColumn("_place", F.monotonically_increasing_id()), "placed")
    part, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit(_PLACES))
    most = table.agg(F.max(part).alias("part"), F.max(at).alias("at")).first()
    if most.part is None:
        return table.withColumn("index", F.col("_place")).drop("_place"), 0, 1, 0
    block = min(BLOCK_ROWS, most.at + 1)
    share = -(-(most.at + 1) // block) * block
    return table.withColumn("index", part * share + at).drop("_place"), (most.part + 1) * share, block, most.part + 1


def blocks(df: DataFrame, vector: str, rows: int, dims: int, block: int) -> BlockMatrix:
    """(index, vector) as a matrix of one column of blocks."""
    plain = MLUtils.convertVectorColumnsFromML(df.select("index", array_to_vector(vector).alias("vector")), "vector")
    return IndexedRowMatrix(plain, rows, dims).toBlockMatrix(block, dims)


def product(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a * b with the middle dimension cut into `splits`, summed afterwards.

    Without them all blocks of a tall matrix and its transpose would go to
    the one task that makes the only block of the result.
    """
    found = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(found, a.rowsPerBlock, b.colsPerBlock)


def scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """The sum of outer products of the rows: dims x dims, so it fits the driver."""
    found = product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()
    return (found + found.T) / 2


def projected(matrix: BlockMatrix, weights: np.ndarray, spark: SparkSession) -> DataFrame:
    """(index, projected): rows of `matrix` times the weights; rows of zeros stay such rows."""
    dims, k = weights.shape
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(dims, k, weights.ravel("F").tolist()))], 1), dims, k, dims, k)
    size = matrix.rowsPerBlock
    found = product(matrix, right, 1).blocks.map(lambda b: (b[0][0], np.ascontiguousarray(b[1].toArray()).tobytes()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(data)
                index = np.arange(len(values) // k, dtype=np.int64) + number * size
                yield pa.RecordBatch.from_arrays([pa.array(index), pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, k, dtype=np.int32)), pa.array(values))], names=["index", "projected"])

    return spark.createDataFrame(found, "block int, data binary").mapInArrow(rows, "index long, projected array<double>")


def fit(distinct: DataFrame, rows: int, block: int, parts: int, components: int) -> Whitening:
    """From (index, x), each x once. Components without variance are left out."""
    n, dims = length_of(distinct, "x")
    sums = [int(s) for s in distinct.agg(*(F.sum(F.element_at("x", i + 1)) for i in range(dims))).first()]
    start = Whitening(n, sums, np.empty(0), np.empty((dims, 0)), 0.0)
    covariance = scatter(blocks(distinct.withColumn("x", start.centred(F.col("x"))), "x", rows, dims, block), parts) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > max(values[0], 0.0) * dims * np.finfo(float).eps).sum()))
    return Whitening(n, sums, values[:k], vectors[:, :k], float(np.trace(covariance)))


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000, components: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Rows whose vector is null or has a null or non-finite entry go; null ids
    and repeated rows stay, each with its own result. Entries become
    floor(scale * c) + offset. The fit list has each such vector once (reduced
    before the shuffle). Fewer dimensions, or a fit list of lower rank, give
    fewer components; one without any variance, or an empty table, gives no
    row. Vectors of several lengths are an error, and so is an entry that
    doesn't fit 64 bits. Other columns are ignored. Ties of eigenvalues leave
    the choice of axes to eigh, the same for all rows.
    """
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[id_col].dataType.simpleString()
    vector = F.col(vector_col)
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))
    table, rows, block, parts = placed(df.where(finite(vector)).select(F.col(id_col).alias("id"), x.alias("x")))
    n, dims = length_of(table, "x")
    model = None
    if n and dims:
        # a vector's place among the fit list is the first of its rows
        distinct = written(table.groupBy("x").agg(F.min("index").alias("index")), "fit")
        model = fit(distinct, rows, block, parts, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    k = len(model.values)
    found = written(projected(blocks(table.withColumn("x", model.centred(F.col("x"))), "x", rows, dims, block), model.matrix, spark), "projected")
    fitted = found.join(distinct.select("index"), "index", "left_semi")
    means = list(fitted.agg(*(F.avg(F.element_at("projected", i + 1)) for i in range(k))).first())
    centred = fitted.withColumn("projected", F.zip_with("projected", F.lit(means), lambda c, m: c - m))
    error = float(np.abs(scatter(blocks(centred, "projected", rows, k, block), parts) / model.n - np.eye(k)).max())
    shares = F.lit([float(e) / model.trace for e in model.values])
    out = table.select("index", "id", model.deviation(F.col("x")).alias("deviation")).join(found, "index")
    out = out.select("id", "deviation", F.posexplode("projected").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
