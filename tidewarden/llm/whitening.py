"""Whitening of vectors with distributed block matrices.

Every distinct vector of whole numbers is a row of the fit matrix. Its rows are numbered, centred and
cut into blocks; the transposed matrix times itself is the scatter, whose eigenvectors are found on
the driver (dimension x dimension numbers). All rows, numbered too, are then multiplied by the
whitening matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import keep, numbered

BLOCK_CELLS = 1 << 19  # numbers in a block: 4 MB
TINY = 1e-12  # of the largest eigenvalue: below it a direction counts as flat
LONG = 2.0**63


def _blocks(rows: DataFrame, n: int, centre: list[float]) -> BlockMatrix:
    """The n centred rows (index, x) as a block matrix."""
    mean = F.array(*[F.lit(c) for c in centre])
    centred = F.zip_with("x", mean, lambda x, m: x.cast("double") - m)
    vectors = rows.select("index", array_to_vector(centred).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, len(centre))
    return matrix.toBlockMatrix(max(1, BLOCK_CELLS // len(centre)), len(centre))


def _local(matrix: np.ndarray, spark) -> BlockMatrix:
    """A small matrix as a block matrix of one block."""
    block = DenseMatrix(matrix.shape[0], matrix.shape[1], matrix.ravel("F").tolist())
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), matrix.shape[0], matrix.shape[1])


def _scatter(matrix: BlockMatrix, parts: int) -> np.ndarray:
    """The transposed matrix times itself; the sums over rows are split into `parts` tasks."""
    transposed = matrix.transpose()
    product = transposed._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, transposed.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def whole(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id and x, the floor of scale times each component, of the rows that take part."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < LONG))
    rows = embeddings.select("vec_id", "embedding").where(F.coalesce(fine & (F.size("embedding") > 0), F.lit(False)))
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def whiten(embeddings: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error.

    One row per vector and component, the components by falling eigenvalue. The fit counts each
    distinct vector once; n is their number. `deviation` is exact: the sum of (n * x - sum)^2 over
    the dimensions, null where no long can hold it. Vectors that are null, empty, or hold null,
    non-finite or (times `scale`) larger entries than a long take no part, nor do those whose
    length differs from the longest one. Directions in which the vectors do not vary have null in
    `whitened` and stay out of `identity_error`. Repeated rows, null vec_ids included, each get
    their rows; an empty table gives none; other columns than vec_id and embedding are not read.

    To the driver come the sums, the scatter (dimension^2 numbers) and the place of each block.
    """
    spark = embeddings.sparkSession
    rows = whole(embeddings, scale)
    dim = rows.agg(F.max(F.size("x")).alias("d")).first()["d"]
    if dim is None:
        nothing = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
        return rows.select("vec_id", *[F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()])
    rows = numbered(rows.where(F.size("x") == dim), "index", "whole")
    distinct = numbered(rows.groupBy("x").agg(F.count("*").alias("_")).select("x"), "index", "distinct")
    sums = distinct.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("s"))
    total = {r["pos"]: int(r["s"]) for r in sums.collect()}
    total, n = [total[i] for i in range(dim)], distinct.count()
    centre = [s / n for s in total]

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fit = _blocks(distinct, n, centre)
    values, vectors = np.linalg.eigh(_scatter(fit, parts) / n)
    order = np.argsort(-values, kind="stable")[: min(components, dim)]
    top, axes = values[order], vectors[:, order]
    varies = top > max(values.max(), 0) * TINY
    explained = [float(v / values.sum()) if values.sum() > 0 else None for v in np.maximum(top, 0)]
    weights = np.where(varies, axes / np.sqrt(np.where(varies, top, 1)), 0)
    whitening = _local(weights, spark)
    covariance = _scatter(fit.multiply(whitening), parts)[np.ix_(varies, varies)] / n
    error = float(np.abs(covariance - np.eye(len(covariance))).max()) if varies.any() else None

    projected = _blocks(rows, rows.count(), centre).multiply(whitening).toIndexedRowMatrix()
    projected = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    projected = projected.select("index", vector_to_array("vector").alias("y"))

    wide = "decimal(38,0)"
    gap = F.zip_with("x", F.array(*[F.lit(s).cast(wide) for s in total]), lambda x, s: F.lit(n).cast("decimal(19,0)") * x.cast("decimal(19,0)") - s)
    square = F.transform(gap, lambda g: F.try_multiply(g.cast("decimal(38,0)"), g.cast("decimal(38,0)")))
    deviation = F.aggregate(square, F.lit(0).cast(wide), lambda a, g: F.try_add(a, g).cast(wide))
    base = rows.select("index", "vec_id", deviation.try_cast("long").alias("deviation"))
    shown = F.array(*[F.struct(F.lit(i + 1).alias("component"), (F.get("y", F.lit(i)) if v else F.lit(None).cast("double")).alias("whitened"), F.lit(e).cast("double").alias("explained")) for i, (v, e) in enumerate(zip(varies.tolist(), explained, strict=True))])
    out = base.join(projected, "index").select("vec_id", "deviation", F.inline(shown))
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
