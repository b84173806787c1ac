"""Embedding whitening: Chebyshev-filtered subspace iteration over distributed passes.

Every pass multiplies a block Q by the covariance of the centred vectors: tasks sum Zᵀ(ZQ) over their rows, Spark adds
the sums, and only dimensions x block numbers reach the driver. A recurrence of such passes is a Chebyshev polynomial
that damps the unwanted part of the spectrum; then QR and Rayleigh-Ritz, until the residuals certify the components.

Vectors that are null or hold null or non-finite entries take no part; all others are in the fit, zero vectors, repeated
rows and null ids too. A shorter vector counts 0 in the dimensions that it lacks. Components without variance (below
1e-12 of the first) have no whitened value and no rows: constant vectors, one vector or none give no rows. Other columns
are not looked at. Numbers beyond a long (huge entries, or deviations of very many rows) raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebill.llm.common import read, stored

COMPONENTS, BLOCK, DEGREE = 8, 32, 12  # wanted, columns of the block, degree of the filter
EXACT, ENOUGH, TURNS = 1e-12, 1e-9, 60  # residuals against the first eigenvalue: wanted, accepted once they stand still; most turns
SCALE, SHIFT = 1024, 100_000
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Model(NamedTuple):
    n: int
    sums: list[int]  # a dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # [dimensions, components]
    trace: float
    residual: float  # largest of the components, against the first eigenvalue


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of long) of the vectors that take part (vec_id, embedding), all of one length."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    dims = v.agg(F.max(F.size("embedding"))).first()[0]
    x = F.transform("embedding", lambda c: F.floor(c * SCALE) + SHIFT)
    return v.select("vec_id", F.concat(x, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dims or 0) - F.size("embedding"))).alias("x"))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    x = b["x"]
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly."""
    if x.size and float(np.abs(x).max()) * n + float(np.abs(sums).max()) >= 2.0**62:
        raise OverflowError("n * x is beyond a long")
    return n * x - sums


def _added(x: DataFrame, work, width: int) -> np.ndarray:
    """The sum over all tasks of the matrices [rows, width] that ``work`` makes of batches of vectors."""
    cols = [f"v{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                m = work(_matrix(b))
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *map(pa.array, total.T)], names=["i", *cols])

    parts = x.select("x").mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in cols))
    rows = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in cols]).collect()  # a row a dimension or component
    return np.array([r[1:] for r in sorted(rows)])


def _sums(x: DataFrame) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if len(b):
                s = np.array(_matrix(b).sum(0).tolist(), object)
                n, total = n + len(b), s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))]), pa.array([n, *total.tolist()], pa.int64())], names=["i", "s"])

    rows = x.select("x").mapInArrow(run, "i long, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r["i"]: int(r["s"]) for r in rows}
    return found.pop(-1, 0), [found[i] for i in sorted(found)]


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    y = _centred(x, n, sums)
    most = int(np.abs(y).max()) if y.size else 0
    if most * most * y.shape[1] < 1 << 63:
        return (y * y).sum(1)
    return np.array([sum(int(v) ** 2 for v in row) for row in y.tolist()], np.int64)


def fit(x: DataFrame, components: int = COMPONENTS, block: int = BLOCK, degree: int = DEGREE, seed: int = 7) -> Model:
    """Mean, eigenvalues and components of the covariance of x (vec_id, x: stored rows of one length)."""
    n, sums = _sums(x)
    dims = len(sums)
    if not n or not dims:
        return Model(n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0)
    s = np.array(sums, np.int64)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_deviations(_matrix(b), n, s))], names=["d"])

    total = x.select("x").mapInArrow(squares, "d long").agg(F.sum(F.col("d").cast("decimal(38,0)"))).first()[0]
    trace = float(Fraction(int(total)) / n**3)

    def times(q: np.ndarray) -> np.ndarray:
        def work(rows: np.ndarray) -> np.ndarray:
            z = _centred(rows, n, s) / n
            return z.T @ (z @ q)

        return _added(x, work, q.shape[1]) / n

    b, want = min(dims, max(block, components)), min(dims, components)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, b)))[0]
    before = np.inf
    for _ in range(TURNS):
        w = times(q)
        values, u = np.linalg.eigh((q.T @ w + w.T @ q) / 2)
        values, u = values[::-1], u[:, ::-1]
        q, w = q @ u, w @ u
        top = max(values[0], 0.0)
        if top <= 1e-12 * max(trace, 1.0):
            return Model(n, sums, np.zeros(0), np.zeros((dims, 0)), trace, 0.0)
        residual = float(np.linalg.norm(w - q * values, axis=0)[:want].max() / top)
        if residual <= EXACT or residual <= ENOUGH and residual > before / 2:
            break
        before = residual
        half = values[-1] / 2  # the unwanted part lies in 0 .. values[-1]
        if half <= 1e-13 * top:  # the block holds the whole range of the covariance
            q = np.linalg.qr(w)[0]
            continue
        old, new = q, (w - half * q) / half
        for _ in range(degree - 1):
            old, new = new, 2 * (times(new) - half * new) / half - old
        q = np.linalg.qr(new / np.linalg.norm(new, axis=0))[0]
    else:
        raise ArithmeticError(f"components not certified: residual {residual:.2g}")
    keep = int((values[:want] > 1e-12 * top).sum())
    vectors = q[:, :keep]
    return Model(n, sums, values[:keep], vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(keep)]), trace, residual)


def whitened(x: DataFrame, m: Model) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each row and component."""
    spark, k = x.sparkSession, len(m.values)
    if not k:
        return spark.createDataFrame([], OUT)
    s, n, project = np.array(m.sums, np.int64), m.n, m.vectors / np.sqrt(m.values)

    def moments(rows: np.ndarray) -> np.ndarray:
        w = _centred(rows, n, s) / n @ project
        return np.vstack([w.T @ w, w.sum(0)])

    got = _added(x, moments, k) / n
    error = float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _matrix(b)
            w = _centred(rows, n, s) / n @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * k + 1, k, dtype=np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(_deviations(rows, n, s)), lists], names=["vec_id", "deviation", "w"])

    out = x.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, w array<double>")
    share = F.array(*[F.lit(float(v / m.trace)) for v in m.values])
    out = out.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return out.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"),
        F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = stored(integers(read(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
    return whitened(x, fit(x))
