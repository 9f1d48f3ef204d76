"""Whitening of vectors: centred scatter in parallel, eigenvectors of it by cyclic Jacobi rotations on the driver.

A rotation of two dimensions takes their off-diagonal entry of the symmetric matrix to zero. A sweep turns every
pair once, in a tournament order whose rounds hold disjoint pairs, and sweeps go on until every entry is below the
rounding of its two diagonal entries. That test is relative to each pair, which is what makes small eigenvalues as
accurate as large ones. Only the matrix, whose size is that of the dimensions, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.llm import common

#: Entries times ``SCALE``, floored, plus ``SHIFT``: whole numbers, so that sums and squares are exact.
SCALE, SHIFT = 1024, 100000
#: Entries that leave this range once scaled are taken as its bounds.
BOUND = float(2**50)
#: An eigenvalue below this share of the largest is zero: its component carries nothing but rounding.
RANK = 1e-14


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and the unit eigenvectors of a symmetric matrix, as columns."""
    a = np.array(matrix, dtype=float)
    d = len(a)
    vectors = np.eye(d)
    seats = list(range(d + d % 2))  # an odd one sits out
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            pairs = [(min(x, y), max(x, y)) for x, y in zip(seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]) if max(x, y) < d]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            off, x, y = a[p, q], a[p, p], a[q, q]
            on = np.abs(off) > np.finfo(float).eps * np.sqrt(np.abs(x)) * np.sqrt(np.abs(y))
            if not on.any():
                continue
            turned = True
            p, q, off, x, y = p[on], q[on], off[on], x[on], y[on]
            with np.errstate(over="ignore"):
                tau = (y - x) / (2 * off)
                tan = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            cos = 1 / np.hypot(1.0, tan)
            sin = tan * cos
            for m in (a, vectors):  # the columns p and q
                left, right = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = left * cos - right * sin, left * sin + right * cos
            left, right = a[p].copy(), a[q].copy()
            a[p], a[q] = left * cos[:, None] - right * sin[:, None], left * sin[:, None] + right * cos[:, None]
            a[p, p], a[q, q] = x - tan * off, y + tan * off
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def whole(vector: str) -> Column:
    """Entries as whole numbers, or null where the vector is null or an entry is null or not finite."""
    c = F.col(vector).cast("array<double>")
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(c, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(BOUND)), F.lit(-BOUND))) + SHIFT)
    return F.when(c.isNotNull() & (F.size(c) > 0) & F.coalesce(finite, F.lit(False)), scaled)


def matrix_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def summed(df: DataFrame, column: str, d: int, centre: np.ndarray) -> np.ndarray:
    """Sum over all rows of the outer product of ``column`` less ``centre`` with itself; a task adds its own rows first."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0)) - centre
                total += x.T @ x
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    parts = df.select(column).mapInArrow(scatter, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    for i, j, v in parts.collect():  # d (d + 1) / 2 rows
        out[i, j] = out[j, i] = v
    return out


def whitened(spark: SparkSession, vectors: DataFrame, most: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component, up to ``most`` of them.

    Vectors that are null or hold null or non-finite entries are left out, and so are vectors of another length
    than the commonest one (the longer of two as common). Rows with a null or repeated id each stand for
    themselves. Entries are taken as floor(1024 c) + 100000, within plus or minus 2^50 before the shift;
    ``deviation`` is the exact sum of (n x - S)^2 as decimal(38,0). A component without variance (constant
    vectors, fewer rows than dimensions) has ``whitened`` and ``explained`` 0 and does not count in
    ``identity_error``; equal eigenvalues share a plane, in which any two directions may be returned. An empty
    table gives no rows. Columns besides these two are not read.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), whole(vector).alias("x")).where("x is not null")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    d, n = sizes
    rows = rows.where(F.size("x") == d)
    at = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
    sums = [int(r["s"]) for r in at.orderBy("i").collect()]  # a row a dimension
    mean = np.array([s // n + s % n / n for s in sums])
    values, axes = jacobi(summed(rows, "x", d, mean) / n)
    trace, found = values.sum(), min(most, d)
    real = [bool(values[k] > RANK * max(values[0], 0)) for k in range(found)]
    turn = np.stack([axes[:, k] / np.sqrt(values[k]) if real[k] else np.zeros(d) for k in range(found)], axis=1)
    safe = 2**62 // d

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("x"))
            far = [max(abs(int(hi) * n - s), abs(int(lo) * n - s)) for hi, lo, s in zip(x.max(axis=0), x.min(axis=0), sums)]
            exact, total = (x, np.array(sums)) if max(far) ** 2 < safe and max(map(abs, sums)) < 2**62 else (x.astype(object), np.array(sums, dtype=object))
            deviation = ((exact * n - total) ** 2).sum(axis=1)
            w = (x - mean) @ turn
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([int(v) for v in deviation], pa.decimal128(38, 0)), pa.ListArray.from_arrays(np.arange(0, w.size + 1, found, dtype=np.int32), w.ravel())], names=["vec_id", "deviation", "w"]
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    done = common.stage(spark, rows.mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), w array<double>"), "whitened")
    means = done.agg(*(F.avg(F.get("w", F.lit(k))).alias(f"m{k}") for k in range(found))).first()
    spread = summed(done, "w", found, np.array(means)) / n
    own = np.flatnonzero(real)
    error = float(np.abs(spread[np.ix_(own, own)] - np.eye(len(own))).max()) if len(own) else 0.0
    explained = F.array(*(F.lit(float(values[k] / trace) if real[k] else 0.0) for k in range(found)))
    out = done.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
