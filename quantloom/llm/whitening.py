"""Embedding whitening: leading principal components by Chebyshev-filtered subspace iteration.

Vectors become integers, ``floor(256 c)``. The fit list holds each distinct one once, packed
into blocks of rows. All that is asked of it are passes: every task centres its rows, multiplies
them by a thin block Q and adds up its part of XᵀXQ, so a pass moves one small block per task and
the covariance itself is never formed. Two passes over a random block give a first subspace and the
bounds of the spectrum. Then each round runs the three-term Chebyshev recurrence over passes, which
keeps directions below the subspace's smallest value small while those above grow, orthonormalises the result
(QR) and solves the small problem inside it (Rayleigh-Ritz), until the residuals of the wanted
pairs are at rounding error, or as small as they get and below ``CERTIFIED`` of the largest value.

Only blocks of dimension x ``BLOCK`` numbers reach the driver. Sums that must be exact are integers.

Defined cases: rows whose vector is null, empty or holds a null or a number that is not finite are
left out, as are vectors that have not the most frequent length (of equally frequent ones the
largest); repeated rows count once in the fit list and each get their result; ids may be null or repeat; components
whose variance is zero within rounding give no rows, so neither do tables of one distinct
vector; an empty table gives no rows; entries beyond the 64-bit range are cut to it, and a
deviation beyond it is null; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quantloom.llm.common import shield
from quantloom.session import stored

SCALE = 256.0
#: Directions carried beside the wanted ones, passes of the recurrence per round, rounds at most.
GUARD = 20
DEGREE = 10
ROUNDS = 60
#: Residuals, as parts of the largest value: aimed at (times the root of the dimension), and accepted when they fall no more.
AIM, CERTIFIED = 4 * np.finfo(float).eps, 1e-10
#: Numbers in a block of the fit list.
BLOCK_NUMBERS = 1 << 18
PACKED = "n_rows int, kind string, data binary, sums array<string>"


def integers(c: Column) -> Column:
    """A vector's entries as the integers that all statistics are about."""
    return F.transform(c, lambda x: F.floor(F.lit(SCALE) * x.cast("double")))


def usable(c: Column) -> Column:
    return (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows ``vec_id`` and ``x`` (array of long) of the usable vectors of the most frequent length."""
    inner, (i, v) = shield(embeddings, id_col, vector_col)
    rows = inner.select(F.col(i).alias("vec_id"), F.col(v).alias("v")).filter(F.col("v").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = 0 if sizes is None else sizes["size"]
    return rows.filter(F.size("v") == size).select("vec_id", integers(F.col("v")).alias("x"))


def narrow(x: np.ndarray) -> np.ndarray:
    """``x`` in the smallest of the integer types that holds it."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(k for k in ("i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return x.astype(kind)


def matrix_of(column: pa.Array) -> np.ndarray:
    """The rows of a column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed(fit: DataFrame) -> DataFrame:
    """Distinct vectors ``x`` in blocks, with exact sums of each block as decimal text."""
    schema = to_arrow_schema(T.StructType.fromDDL(PACKED))

    def block(x: np.ndarray) -> pa.RecordBatch:
        small = narrow(x)
        exact = len(x) * int(max(abs(int(x.min())), abs(int(x.max())))) < 2**63
        sums = (x if exact else x.astype(object)).sum(axis=0)
        values = [len(x), small.dtype.str, small.tobytes(), [str(int(s)) for s in sums]]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(matrix_of(batch.column("x")))
                n += held[-1].size
            if n >= BLOCK_NUMBERS:
                yield block(np.concatenate(held))
                held, n = [], 0
        if held:
            yield block(np.concatenate(held))

    return fit.select("x").mapInArrow(run, PACKED)


class Fit(NamedTuple):
    """``n`` vectors with ``sums`` per dimension; unit ``components`` (columns) with ``values``, their variances;
    the ``trace`` of the covariance, the largest ``residual`` of a pair and the ``identity_error``."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


class Passes:
    """Products of the covariance of stored blocks with thin matrices, and its trace."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.blocks, self.n, self.count = blocks, n, 0
        self.mean = np.array([s / n for s in sums])
        # One partial result per task of a second, smaller stage reaches the driver.
        self.few = max(1, math.isqrt(blocks.rdd.getNumPartitions()))

    def _total(self, make) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                    found = make(np.frombuffer(data.as_buffer(), kind))
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["data"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [np.frombuffer(d.as_buffer()) for batch in batches for d in batch.column("data")]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0).tobytes()])], names=["data"])

        sums = self.blocks.select("kind", "data").mapInArrow(partial, "data binary").repartition(self.few).mapInArrow(added, "data binary")
        self.count += 1
        return np.sum([np.frombuffer(bytes(r["data"])) for r in sums.collect()], axis=0) / self.n

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times ``q``; the last entry of a pass, the trace, is kept as ``trace``."""
        mean, thin = self.mean, np.ascontiguousarray(q)

        def make(flat: np.ndarray) -> np.ndarray:
            x = flat.reshape(-1, len(mean)).astype(float) - mean
            return np.append((x.T @ (x @ thin)).ravel(), np.vdot(x, x))

        found = self._total(make)
        self.trace = float(found[-1])
        return found[:-1].reshape(q.shape)


def filtered(times, q: np.ndarray, vq: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of ``degree`` that is small on [low, cut], of the operator ``times``, applied to ``q``.

    ``vq`` is ``times(q)``; values are scaled so that the polynomial is 1 at ``top``.
    """
    half, centre = (cut - low) / 2, (cut + low) / 2
    sigma = first = half / (top - centre)
    before, here = q, (vq - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, here = here, (times(here) - centre * here) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return here


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (falling), vectors and their images of the operator inside the span of orthonormal ``q``."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def leading(times, d: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenpairs of the positive operator ``times`` on ``d`` dimensions, and their residual."""
    wanted, size = min(wanted, d), min(d, wanted + GUARD)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, size)))[0]
    vq = times(q)
    if size < d:
        # A second block of the Krylov space: a start, and both ends of the spectrum.
        more = np.linalg.qr(np.hstack([q, vq]))[0][:, size : min(d, 2 * size)]
        q, vq = np.hstack([q, more]), np.hstack([vq, times(more)])
    values, q, vq = ritz(q, vq)
    low = max(0.0, float(values[-1] - np.linalg.norm(vq[:, -1] - values[-1] * q[:, -1])))
    best = None
    for _ in range(ROUNDS):
        top = float(values[0])
        if top <= 0:
            return values[:0], q[:, :0], 0.0
        residual = float(np.max(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0))) / top
        steady = best is not None and residual > best[2] / 2 and best[2] <= CERTIFIED
        if best is None or residual < best[2]:
            best = values[:wanted], q[:, :wanted], residual
        if residual <= AIM * math.sqrt(d) or steady or q.shape[1] >= d:
            return best
        values, q, vq = values[:size], q[:, :size], vq[:, :size]
        cut = float(values[-1])
        low = low if low < cut * (1 - 1e-6) else 0.0
        q = np.linalg.qr(filtered(times, q, vq, DEGREE, low, cut, top))[0]
        vq = times(q)
        values, q, vq = ritz(q, vq)
        # What lies below the assumed lower end grows too, and shows itself here.
        low = min(low, max(0.0, float(values[-1])))
    raise RuntimeError(f"components not certified: a residual of {best[2]:.1e} after {ROUNDS} rounds")


def fit(rows: DataFrame, wanted: int = 4) -> Fit | None:
    """Components of the distinct vectors among ``rows`` (``vectors``); None if there are none."""
    blocks = stored(packed(rows.select("x").distinct()), "vectors")
    total = F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")
    sums = blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(total).collect()
    if not sums:
        return None
    n = blocks.agg(F.sum("n_rows").alias("n")).first()["n"]
    exact = [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])]
    passes = Passes(blocks, n, exact)
    values, components, residual = leading(passes.times, len(exact), wanted)
    keep = values > len(exact) * np.finfo(float).eps * max(values, default=0)
    values, components = values[keep], components[:, keep]
    error = 0.0
    if len(values):
        scaled = components / np.sqrt(values)
        error = float(np.abs(scaled.T @ passes.times(scaled) - np.eye(len(values))).max())
    return Fit(n, exact, components, values, passes.trace, residual, error, passes.count)


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, found: Fit | None) -> DataFrame:
    """Per row of ``rows`` and component: ``component`` (from 1), ``n``, ``deviation`` (squared distance of n x from the sums),
    ``whitened``, ``explained`` and ``identity_error``."""
    spark = rows.sparkSession
    schema = T.StructType([rows.schema["vec_id"], *T.StructType.fromDDL(OUT)])
    if found is None or not len(found.values):
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        k, sums = len(f.values), np.array(f.sums, object)
        scaled = f.components / np.sqrt(f.values)
        explained = f.values / f.trace
        safe = np.iinfo(np.int64).max
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix_of(batch.column("x"))
            reach = f.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, f.sums))
            if reach * reach * len(f.sums) <= safe:
                apart = x * f.n - sums.astype(np.int64)
                deviation = pa.array((apart * apart).sum(axis=1))
            else:
                apart = x.astype(object) * f.n - sums
                deviation = pa.array([v if v <= safe else None for v in (apart * apart).sum(axis=1).tolist()], pa.int64())
            white = (apart / f.n).astype(float) @ scaled
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n, np.int64)),
                deviation.take(each), pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, f.identity_error)),
            ], names=schema.names)

    return rows.mapInArrow(run, schema)
