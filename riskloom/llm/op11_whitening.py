"""Operator 11: whitening of embeddings by shifted Cholesky QR.

The centred rows Y (n x d) are never gathered. Each pass sends every row through the triangular factors so far (q = y R^-1), adds up
the Gram matrix of the q in each task and sums these matrices in Spark; the driver gets one d x d matrix. Its Cholesky factor,
taken with a shift of the diagonal where rounding could make the matrix indefinite, is multiplied onto R. After two or three passes the q are
orthonormal to rounding, so Y = QR and the singular values of R, a d x d matrix, are those of Y: components are R's right
singular vectors, eigenvalues of the covariance are squared singular values over n. The condition number of Y enters R once and not squared, as it
would in the eigenvectors of one Gram matrix.

Entries c become whole numbers x = floor(1024 c) + 100000, so that n, the sums S and n x - S are exact at every size.

Defined results: a row goes whose vector is null or has a null, NaN or infinite entry; null and repeated ids are rows of their own;
repeated rows count as often as they are there; an empty table, and one in which no vector is left or all are equal, gives an empty result; directions
without variance (a singular value below 1e-11 of the largest) are no components; vectors of different lengths, and entries beyond 2^40, are an
error, as is a table whose n x doesn't fit 64 bits; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import column, write_stage

SCALE, ORIGIN = 1024, 100_000
COMPONENTS = 8
#: Passes after which rows that still aren't orthonormal are an error; two to four are used.
MOST_PASSES = 8
#: Largest entry of the Gram matrix less the identity that counts as rounding.
ORTHONORMAL = 1e-10
#: Singular values below this share of the largest are no direction of the data.
RANK_TOLERANCE = 1e-11


def scaled_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Columns ``vec_id, x``: rows with whole and finite vectors, as whole numbers."""
    v = column(vector_col)
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))

    def whole(c):
        return F.when(F.abs(c.cast("double")) <= float(2**40), F.floor(c.cast("double") * SCALE) + ORIGIN).otherwise(F.raise_error(F.lit("an entry is beyond 2^40")).cast("long"))

    return df.where(v.isNotNull() & ~odd).select(column(id_col).alias("vec_id"), F.transform(v, whole).alias("x"))


def matrices(batches: Iterator, d: int, rows: int = 4096) -> Iterator[tuple]:
    """Arrow batches as (ids, whole numbers of shape rows x d), in parts of bounded size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less its mean: the difference is taken in whole numbers, so nothing cancels."""
    return (x * n - sums) / n


def summed(vectors: DataFrame, per_task: Callable[[Iterator], np.ndarray], length: int) -> np.ndarray:
    """Sum over all tasks of a vector of numbers per task. Spark sums by place: the driver gets ``length`` numbers, however many tasks there are."""

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(per_task(batches))], ["place", "value"])

    got = vectors.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(length)
    for place, value in got:
        out[place] = value
    return out


def gram(vectors: DataFrame, n: int, sums: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the centred rows after they went through the factors so far, one after the other: going through their product at once
    would bring back the rounding that each of them takes away."""
    d = len(sums)

    def per_task(batches):
        total = np.zeros((d, d))
        for _, x in matrices(batches, d):
            q = centred(x, n, sums)
            for r in factors:
                q = solved(q, r)
            total += q.T @ q
        return total.ravel()

    g = summed(vectors, per_task, d * d).reshape(d, d)
    return (g + g.T) / 2


def cholesky(g: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """Upper triangular R with R'R = g, or g plus a shift that outweighs the rounding of g's sums: 11 (n d + d (d + 1)) u |g|, the bound
    under which the factorisation can't break down."""
    d = len(g)
    size = float(np.linalg.norm(g, 2))
    least = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * size
    if not shift:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    # at very many rows the bound outgrows the matrix, although sums by task don't lose as much
    return np.linalg.cholesky(g + min(least, 1e-6 * size) * np.eye(d)).T


def solved(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """y R^-1 by substitution, column after column, for all rows at once."""
    q = np.empty_like(y, order="F")
    for j in range(len(r)):
        q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def shifted_cholesky_qr(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows, without the directions that have no variance. The first pass is shifted; later ones only where their matrix
    isn't positive definite.

    Every pass, shifted or not, keeps Y = QR. A direction without variance is rounding in Q and never becomes orthonormal, but its part of R
    shrinks by the root of each shift and falls below ``RANK_TOLERANCE``; passes end when Q is orthonormal in all other directions.
    """
    d = len(sums)
    r, factors = np.eye(d), []
    for k in range(MOST_PASSES):
        g = gram(vectors, n, sums, factors)
        if not g.any():
            return np.zeros((0, d))
        if k:
            left, sizes, right = np.linalg.svd(r)
            live = sizes > RANK_TOLERANCE * sizes[0]
            inner = left[:, live].T @ g @ left[:, live]
            if np.abs(inner - np.eye(len(inner))).max() < ORTHONORMAL:
                return np.linalg.cholesky(inner).T @ (sizes[live, None] * right[live])  # the last rounding goes too
        step = cholesky(g, n, shift=k == 0)
        r = step @ r
        factors.append(step)
    raise RuntimeError(f"rows aren't orthonormal after {MOST_PASSES} passes")


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum over dimensions of (n x - S)^2 for each row, exact at every size: in 64 bits where it surely fits, else by halves."""
    y = x * n - sums
    most = int(np.abs(y).max(initial=0))
    if most * most * max(1, y.shape[1]) < 2**63:
        return (y * y).sum(axis=1).tolist()
    high, low = y >> 24, y & (2**24 - 1)
    if int(np.abs(high).max()) ** 2 * y.shape[1] >= 2**63:
        return [sum(int(v) ** 2 for v in row) for row in y]
    a, b, c = (high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)
    return [(int(i) << 48) + (int(j) << 25) + int(k) for i, j, k in zip(a, b, c, strict=True)]


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Columns ``vec_id, component, n, deviation`` (decimal)``, whitened, explained, identity_error``, a row for each vector and component."""
    vectors = write_stage(scaled_vectors(df, id_col, vector_col), "vectors")
    n, least, most, largest = vectors.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x")), F.max(F.greatest(F.abs(F.array_min("x")), F.abs(F.array_max("x"))))).first()
    if n and least != most:
        raise ValueError(f"vectors have from {least} to {most} entries")
    if n and largest and n * largest >= 2**62:
        raise ValueError("n times the largest entry is beyond 64 bits")
    d = most or 0
    kind = T.StructType([T.StructField("vec_id", df.schema[id_col].dataType)] + [T.StructField(c, t) for c, t in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.DecimalType(38, 0)), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))])
    nothing = df.sparkSession.createDataFrame([], kind)
    if not n or not d:
        return nothing
    sums = column_sums(vectors, d)
    r = shifted_cholesky_qr(vectors, n, sums)
    _, sigma, right = np.linalg.svd(r)
    count = int((sigma[:components] > RANK_TOLERANCE * sigma[0]).sum()) if len(sigma) else 0
    if not count:
        return nothing
    values = sigma**2 / n
    to_white = right[:count].T / np.sqrt(values[:count])
    explained = values[:count] / values.sum()

    def moments(batches):
        total = np.zeros((count + 1, count))
        for _, x in matrices(batches, d):
            z = centred(x, n, sums) @ to_white
            total[:count] += z.T @ z
            total[count] += z.sum(axis=0)
        return total.ravel()

    moment = summed(vectors, moments, (count + 1) * count).reshape(count + 1, count)
    mean = moment[count] / n
    error = float(np.abs(moment[:count] / n - np.outer(mean, mean) - np.eye(count)).max())

    def run(batches):
        import pyarrow as pa

        for ids, x in matrices(batches, d):
            z = centred(x, n, sums) @ to_white
            rows = len(x)
            each = pa.array(np.repeat(np.arange(rows), count))
            far = pa.array([Decimal(v) for v in deviations(x, n, sums)], pa.decimal128(38, 0))
            numbers = [np.tile(np.arange(1, count + 1, dtype=np.int32), rows), np.full(rows * count, n)]
            yield pa.RecordBatch.from_arrays([ids.take(each), *map(pa.array, numbers), far.take(each), pa.array(z.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * count, error))], kind.names)

    return vectors.mapInArrow(run, kind)


def column_sums(vectors: DataFrame, d: int) -> np.ndarray:
    """Exact sums of each dimension, as whole numbers."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(d, np.int64)
        for _, x in matrices(batches, d):
            total += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(total)], ["place", "value"])

    out = np.zeros(d, np.int64)
    for place, value in vectors.mapInArrow(run, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[place] = value
    return out


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("long"))
