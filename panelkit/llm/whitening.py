"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries c become whole numbers x = floor(1024 c) + 100000. Their covariance V (divisor n,
centred first) is never formed: all that is asked of it are products V Q = X'(X Q) / n
with a block Q of a few columns, each one pass over the rows. A pass reads the rows in
packed chunks, and every task sends one d x b partial sum into Spark's aggregation.

1. A random orthonormal block of `block` columns, more than the `k` wanted.
2. A Chebyshev polynomial of V on the block by the three-term recurrence, one pass per
   degree: it stays within 1 on [0, bound], the unwanted part of the spectrum, and grows
   fast above it. `bound` is the smallest Ritz value of the block so far.
3. QR of the filtered block and Rayleigh-Ritz: the eigenproblem of Q'VQ, one more pass.
4. Certified when |V q - theta q| of every wanted pair is at most `tol` theta_1, or when
   it is below `LOOSE` theta_1 and another filter no longer halves it (round-off is reached).

By the residual theorem an eigenvalue lies that close to each Ritz value; the spare
columns of the block keep the wanted ones from being missed. With d <= block the block
spans everything and Rayleigh-Ritz alone is exact.

Defined results: rows with a null vector, or with null or non-finite entries, or without
entries, are left out, as are vectors whose length isn't the most frequent one (ties: the
longest). Components of eigenvalue zero (within round-off) have no whitened value and
are not returned: constant vectors give no rows. Repeated rows and ids, null ids and
extra columns are fine. `deviation` is null beyond the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelkit.session import materialize

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS, SPARE, DEGREE, ROUNDS, SEED = 8, 24, 8, 60, 7
TOL, LOOSE = 1e-14, 1e-9
# Rows of a packed chunk hold about so many entries.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Spectrum:
    """n, per-dimension sums, trace of V; eigenvalues falling, unit eigenvectors as columns; the certificate."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>): the rows that take part, in whole numbers."""
    v = F.col(vector).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return rows.select(F.col(vec_id).alias("vec_id"), v.alias("_v")).filter(
        F.col("_v").isNotNull() & (F.size("_v") > 0) & ~F.exists("_v", bad)
    ).select("vec_id", F.transform("_v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _packed(rows: DataFrame, d: int) -> DataFrame:
    """(m, x): rows packed into chunks of m vectors, 64-bit whole numbers."""
    size = max(1, CHUNK // d)

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, m = [], 0
        def chunk():
            return pa.RecordBatch.from_arrays([pa.array([m]), pa.array([np.concatenate(held).tobytes()], pa.binary())], ["m", "x"])
        for f in frames:
            for at in range(0, f.num_rows, size):
                part = f.column(0).slice(at, size)
                held.append(part.flatten().to_numpy(zero_copy_only=False).astype("<i8", copy=False))
                m += len(part)
                if m >= size:
                    yield chunk()
                    held, m = [], 0
        if m:
            yield chunk()

    return rows.select("x").mapInArrow(pack, "m long, x binary")


def _sum_over(chunks: DataFrame, d: int, mean: np.ndarray, part) -> np.ndarray:
    """The sum over all rows of `part(centred rows)`, an array of a size that depends on the dimensions only."""
    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for f in frames:
            for b in f.column(0):
                x = np.frombuffer(b.as_buffer(), "<i8").reshape(-1, d) - mean
                got = part(x)
                total = got if total is None else total + got
        if total is not None:
            flat = np.asarray(total, np.float64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "value"])

    got = chunks.select("x").mapInArrow(each, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(got.num_rows)
    out[got.column("at").to_numpy()] = got.column("value").to_numpy()
    return out


def spectrum(chunks: DataFrame, n: int, sums: np.ndarray, k: int = COMPONENTS, spare: int = SPARE, degree: int = DEGREE, tol: float = TOL) -> Spectrum:
    """The `k` leading eigenpairs of the covariance of packed rows."""
    d, mean = len(sums), np.array([float(s) / n for s in sums])
    block, passes = min(d, k + spare), 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return _sum_over(chunks, d, mean, lambda x: x.T @ (x @ q)).reshape(q.shape) / n

    trace = float(_sum_over(chunks, d, mean, lambda x: np.array([np.square(x).sum()]))[0] / n)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, block)))[0]

    def ritz(q: np.ndarray):
        vq = times(q)
        h = q.T @ vq
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        q, vq = q @ s, vq @ s
        return theta, q, vq, float(np.linalg.norm((vq - q * theta)[:, :k], axis=0).max(initial=0.0))

    theta, q, vq, worst = ritz(q)
    wanted = min(k, block)
    for _ in range(ROUNDS):
        if block == d or trace <= 0 or worst <= tol * theta[0]:
            break
        bound = max(float(theta[-1]), float(theta[0]) * 1e-12)
        e = bound / 2  # centre and half width of [0, bound]
        sigma = first = e / (theta[0] - e)
        before, now = q, (vq - e * q) * (sigma / e)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            before, now = now, (times(now) - e * now) * (2 * after / e) - before * (sigma * after)
            sigma = after
        last = worst
        theta, q, vq, worst = ritz(np.linalg.qr(now)[0])
        if worst <= LOOSE * theta[0] and worst > last / 2:
            break
    else:
        raise ArithmeticError(f"no certified eigenpairs after {passes} passes: residual {worst:.3g} of {theta[0]:.3g}")
    real = int((theta[:wanted] > max(theta[0], 0) * 1e-13 + 0.0).sum()) if trace > 0 else 0
    return Spectrum(n, sums, trace, theta[:real], q[:, :real], worst, passes)


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", *, k: int = COMPONENTS) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark, kind = rows.sparkSession, rows.schema[vec_id].dataType.simpleString()
    held = materialize(quantised(rows, vec_id, vector), "whitening-rows")
    length = held.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    fields = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not length:
        return spark.createDataFrame([], f"vec_id {kind}, {fields}")
    d, n = length[0]["d"], length[0]["n"]
    held = held.filter(F.size("x") == d)
    sums = _sums(held, d)
    chunks = materialize(_packed(held, d), "whitening-chunks")
    found = spectrum(chunks, n, sums, k)
    whitener, mean = found.vectors / np.sqrt(found.values), np.array([float(s) / n for s in sums])
    m = whitener.shape[1]
    error = 0.0
    if m:  # of the whitened values themselves, centred once more
        z = _sum_over(chunks, d, mean, lambda x: (x @ whitener).sum(axis=0)) / n
        c = _sum_over(chunks, d, mean, lambda x: (x @ whitener - z).T @ (x @ whitener - z)).reshape(m, m) / n
        error = float(np.abs(c - np.eye(m)).max())
    whole = [int(s) for s in sums]
    # n x - S: whole numbers; squares and sums stay below 2^63 for all rows within this reach.
    reach = int((2**62 / d) ** 0.5)

    def project(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(whole, object)
        short = np.array([s // n for s in whole], np.int64)
        rest = np.array([s % n for s in whole], np.int64)
        for f in frames:
            if not f.num_rows:
                continue
            x = f.column(1).flatten().to_numpy(zero_copy_only=False).reshape(f.num_rows, d)
            far = np.abs(x - short).max(axis=1)
            deviation = np.zeros(f.num_rows, object)
            ok = (far + 2) * float(n) < reach
            away = n * (x[ok] - short) - rest
            deviation[ok] = np.square(away).sum(axis=1)
            for i in np.flatnonzero(~ok):
                v = int(sum((n * int(a) - s) ** 2 for a, s in zip(x[i], exact)))
                deviation[i] = v if v < 2**63 else None
            white = (x - mean) @ whitener
            each = np.repeat(np.arange(f.num_rows), m)
            yield pa.RecordBatch.from_arrays([
                f.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), f.num_rows)),
                pa.array(np.full(len(each), n)), pa.array(list(deviation), pa.int64()).take(pa.array(each)), pa.array(white.ravel()),
                pa.array(np.tile(found.values / found.trace, f.num_rows)), pa.array(np.full(len(each), error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return held.select("vec_id", "x").mapInArrow(project, f"vec_id {kind}, {fields}")


def _sums(held: DataFrame, d: int) -> np.ndarray:
    """Exact sums per dimension, as Python integers."""
    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for f in frames:
            if f.num_rows:
                total = total + f.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([str(int(t)) for t in total])], ["at", "value"])

    got = held.select("x").mapInArrow(each, "at int, value string").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    out = np.zeros(d, object)
    for r in got:
        out[r["at"]] = int(r["value"])
    return out
