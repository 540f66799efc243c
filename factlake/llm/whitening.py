"""Embedding whitening by shifted CholeskyQR.

The vectors' entries become whole numbers x = floor(64 * c) + 1000000. Let A be
the rows x - mean. A = Q R with orthonormal columns of Q, found without ever holding A in
one place: a pass over the rows sums the Gram matrix of the rows as they stand, its
Cholesky factor is the pass's R, and the next pass sees each row after a triangular
solve with all factors so far. The first passes add a shift to the Gram matrix, as long
as rounding could make it indefinite; passes are repeated until it is the identity
to rounding. The composed R has A's singular values and right singular vectors:
eigenvalues of the covariance are their squares over n, and small ones are as exact
as the singular values are, which the covariance's own decomposition would not give.

On Spark: counts and sums are exact and native. Every task adds up its rows' products in
one matrix; matrices are added in two rounds, row by row, ``TASKS`` of them at a time;
the driver holds one matrix of the dimension's square. Entries are centred in whole numbers before they become doubles.

Whitening needs the components in one orientation for all rows; each one's largest
entry (the first of equals) is positive.

Defined cases: a row whose vector is null, or has a null, NaN or infinite entry, is left
out; so is one whose length differs from most vectors' (the longer one of two equally frequent
lengths counts); rows that repeat are rows; x beyond 64 bits stays at the bound, and
a deviation of more than 38 digits is null; dimensions without variance, and directions whose singular value
is below rounding, have no component, so with few or equal vectors there are fewer components,
or no rows at all; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, prepare, written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Passes at most: three settle a matrix of full rank, directions without variance need more.
PASSES = 8
UNIT = 2.0 ** -53
#: Tasks whose matrices are added in one group of the first round.
TASKS = 256
WIDE = 1 << 61


def whole_numbers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the vectors that count, as whole numbers."""
    v = F.col(vector_col).cast("array<double>")
    ok = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.least(F.floor(c * SCALE).cast("long"), F.lit(2**63 - 1 - OFFSET)) + OFFSET)
    return rows.where(ok).select(F.col(id_col), x.alias(fresh(rows.select(id_col), "x")))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The last column, arrays of equal length, as a matrix."""
    col = batch.column(batch.num_columns - 1)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sums by ``i`` of (task, i, values), in two rounds."""
    made = "task int, i int, v array<double>"
    once = parts.withColumn("task", F.expr(f"task div {TASKS}").cast("int")).groupBy("task", "i").applyInArrow(_sum, made)
    return {r.i: np.array(r.v) for r in once.groupBy("i").applyInArrow(_sum, made).collect()}


def _sum(rows: pa.Table) -> pa.Table:
    total = sum(_matrix(b).sum(0) for b in rows.to_batches() if b.num_rows)
    return pa.table({"task": rows["task"][:1], "i": rows["i"][:1], "v": pa.array([total], pa.list_(pa.float64()))})


def gram(rows: DataFrame, turned, d: int) -> np.ndarray:
    """The Gram matrix of ``turned(x)`` over all rows (x arrays)."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                y = turned(_matrix(batch))
                total += y.T @ y
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                         ["task", "i", "v"])

    found = _added(rows.mapInArrow(products, "task int, i int, v array<double>"))
    g = np.stack([found[i] for i in range(d)])
    return (g + g.T) / 2


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], np.ascontiguousarray(m).ravel())


@dataclass
class Whitening:
    n: int
    sums: list[int]            # of x, by dimension
    used: np.ndarray           # dimensions with variance
    components: np.ndarray     # a column each, over all dimensions
    eigenvalues: np.ndarray    # of the covariance, falling
    explained: np.ndarray
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, in doubles: whole parts are taken off as whole numbers."""
        low = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.float64) / self.n
        if len(x) and (x.max() > WIDE or x.min() < -WIDE or np.abs(low).max() > WIDE):  # the difference may pass 64 bits
            return (x.astype(np.float64) - low) - rest
        return (x - low) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) ** 2 by row, exact."""
        n, low = self.n, [s // self.n for s in self.sums]
        rest = [s % self.n for s in self.sums]
        with np.errstate(over="ignore"):
            d = x - np.array(low, np.int64)
        if not len(d) or max(map(abs, (int(x.max()), int(x.min()), *low))) < WIDE and int(np.abs(d).max()) < 1 << 20:
            # n**2 * sum(d**2) - 2 * n * sum(d * rest) + sum(rest**2), rest in parts of 32 bits
            squares = (d * d).sum(1).tolist()
            parts = [(d * np.array([(r >> b) & 0xFFFFFFFF for r in rest], np.int64)).sum(1).tolist() for b in range(0, max(n.bit_length(), 1), 32)]
            crossed = [sum(p << (32 * k) for k, p in enumerate(ps)) for ps in zip(*parts, strict=True)]
            own = sum(r * r for r in rest)
            return [n * n * a - 2 * n * b + own for a, b in zip(squares, crossed, strict=True)]
        return [sum((n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


def cholesky_qr(rows: DataFrame, fit: Whitening) -> np.ndarray:
    """R of the rows' centred used dimensions, by shifted CholeskyQR."""
    d = len(fit.used)
    factors: list[np.ndarray] = []

    def turned(x: np.ndarray) -> np.ndarray:
        y = fit.centred(x)[:, fit.used]
        for r in factors:  # row by row: y := y R^-1
            y = _solved(y, r)
        return y

    for _ in range(PASSES):
        g = gram(rows, turned, d)
        largest = float(np.linalg.norm(g, 2))
        rounding = UNIT * (fit.n ** 0.5 * d + d * (d + 1))  # of sums whose errors are as often up as down
        # Cholesky must not break down: shift while the least eigenvalue may be rounding
        least = float(np.linalg.eigvalsh(g)[0])
        shift = 11 * rounding * largest if least <= 11 * rounding * largest or not factors else 0.0
        factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
        fit.passes += 1
        if not shift and np.abs(g - np.eye(d)).max() < 64 * d * UNIT:
            break
    return reduce(lambda r, f: f @ r, factors)


def _solved(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """y R^-1 for an upper triangular R, column by column."""
    q = np.empty_like(y)
    for j in range(len(r)):
        q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (whole_numbers of one length), None without components."""
    x = rows.columns[-1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, lo, hi = 0, 0, None, None
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch)
                n += len(m)
                # high and low halves, as a sum may pass 64 bits
                total = total + ((m >> 32).sum(0).astype(object) << 32) + (m & 0xFFFFFFFF).sum(0).astype(object)
                lo, hi = (m.min(0), m.max(0)) if lo is None else (np.minimum(lo, m.min(0)), np.maximum(hi, m.max(0)))
        if n:
            d = len(lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(Decimal, total), pa.decimal128(28, 0)), pa.array(lo), pa.array(hi)],
                ["i", "n", "s", "lo", "hi"])

    sums = rows.select(x).mapInArrow(add, "i int, n long, s decimal(28,0), lo long, hi long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("i").collect()
    used = np.array([r.i for r in sums if r.lo != r.hi], np.int64)
    if not len(used):
        return None
    fit = Whitening(sums[0].n, [int(r.s) for r in sums], used, np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0)
    r = cholesky_qr(rows.select(x), fit)
    _, sigma, vt = np.linalg.svd(r)
    whole = int((sigma > sigma[0] * UNIT * 16 * max(len(used), 8)).sum())
    eigen = sigma ** 2 / fit.n
    keep = min(components, whole, fit.n - 1)
    vectors = np.zeros((len(sums), keep))
    vectors[used] = vt[:keep].T
    top = np.abs(vectors).argmax(0)
    fit.components = vectors * np.sign(vectors[top, np.arange(keep)])
    fit.eigenvalues, fit.explained = eigen[:keep], eigen[:keep] / eigen.sum()
    return fit


def one_length(rows: DataFrame) -> DataFrame:
    """The rows of the most frequent length, the longer of equals."""
    x = rows.columns[-1]
    best = rows.groupBy(F.size(x).alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size(x) == (best.d if best else -1))


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, n, deviation (decimal), whitened (array), explained (array), identity_error of
    every vector that counts."""
    prepare(vectors.sparkSession)
    rows = one_length(written(whole_numbers(vectors, id_col, vector_col), "whitening-rows"))
    x = rows.columns[-1]
    fit = fitted(rows, components)
    kind = dict(rows.dtypes)[id_col]
    made = f"id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if fit is None or not len(fit.eigenvalues):
        return rows.where("false").select(F.col(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "array<double>"), ("explained", "array<double>"), ("identity_error", "double"))])
    own = gram(rows.select(x), fit.whitened, len(fit.eigenvalues)) / fit.n
    error = float(np.abs(own - np.eye(len(own))).max())

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, k = _matrix(batch) if batch.num_rows else np.zeros((0, len(fit.sums)), np.int64), batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([fit.n] * k, pa.int64()), pa.array([Decimal(v) if v < 10 ** 38 else None for v in fit.deviations(m)], pa.decimal128(38, 0)),
                 _lists(fit.whitened(m)), _lists(np.broadcast_to(fit.explained, (k, len(fit.explained)))),
                 pa.array([error] * k, pa.float64())], ["id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(id_col, x).mapInArrow(turn, made).withColumnRenamed("id", id_col)

