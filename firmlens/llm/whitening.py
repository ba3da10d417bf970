"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. Every pass multiplies it with a narrow block of vectors:
tasks add up centred XᵀXQ of their rows, Spark adds the tasks. A Chebyshev recurrence over
such passes damps the unwanted part of the spectrum; QR and a Rayleigh-Ritz step follow,
until the residuals certify the wanted eigenvectors.

Entries are whole numbers, so sums and means are exact, and centring loses no digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.vectors import FINITE, matrix
from firmlens.sources.sinks import materialize


@dataclass(frozen=True)
class WhitenConfig:
    """scale, shift: an entry c becomes floor(scale * c) + shift. guard: vectors beyond the wanted ones.

    gain: how much more a filter lets the last wanted vector pass than the unwanted ones.
    spread: how much more it may let the first wanted vector pass than the last.
    """

    components: int = 32
    guard: int = 16
    scale: int = 64
    shift: int = 1_000_000
    tolerance: float = 1e-13
    gain: float = 1e4
    spread: float = 1e8
    max_degree: int = 40
    seed: int = 11


#: Scaled entries beyond this size would not be exact as doubles.
EXACT = 2**52
#: Share of the largest eigenvalue below which a direction counts as having no variance.
NO_VARIANCE = 1e-12
#: A residual that stops falling is accepted below this share of the largest eigenvalue.
ROUNDING = 1e-10


class NotConverged(RuntimeError):
    """The residuals stopped falling before they reached rounding errors."""


def whole_numbers(
    vectors: DataFrame, cfg: WhitenConfig, id_column: str, vector_column: str
) -> DataFrame:
    """(vec_id, x) of the rows that take part, x as whole numbers."""
    v = f"`{vector_column}`"
    return vectors.where(
        f"{v} IS NOT NULL AND forall({v}, x -> {FINITE}) "
        f"AND forall({v}, x -> abs({cfg.scale}D * x) < {EXACT}D)"
    ).select(
        F.col(id_column).alias("vec_id"),
        F.expr(f"transform({v}, c -> floor({cfg.scale}D * cast(c AS double)) + {cfg.shift}L)").alias("x"),
    )


class FitList:
    """The written whole-number vectors, their number, sums and exact centring."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
        self.d = (lengths.first() or [0])[0]
        if lengths.count() > 1:
            self.rows = rows.where(F.size("x") == self.d)
        self.n, self.total = self._sums() if self.d else (0, [])
        self.whole = np.array([s // self.n for s in self.total], np.int64)
        self.rest = [s % self.n for s in self.total]
        self.part = np.array([r / self.n for r in self.rest])

    def _sums(self) -> tuple[int, list[int]]:
        """Exact: each entry in two parts, so that no sum of a task or of all leaves a long."""
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
            for batch in batches:
                x = matrix(batch.column(0), np.int64)
                n += len(x)
                high += (x >> 26).sum(axis=0)
                low += (x & (2**26 - 1)).sum(axis=0)
            if n:
                columns = [np.arange(d), np.full(d, n), high, low]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["dim", "n", "high", "low"]
                )

        parts = self.rows.select("x").mapInArrow(run, "dim long, n long, high long, low long")
        sums = parts.groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")))
        rows = sums.orderBy("dim").collect()  # a row for each dimension
        return rows[0]["n"], [(r["high"] << 26) + r["low"] for r in rows]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2, exact; None where the sum is no long."""
        near = x - self.whole
        top = int(np.abs(near).max(initial=0)) + 1
        if (self.n * top) ** 2 * self.d < 2**63:
            away = near * self.n - np.array(self.rest, np.int64)
            return (away**2).sum(axis=1).tolist()
        away = near.astype(object) * self.n - np.array(self.rest, object)
        return [int(s) if s < 2**63 else None for s in (away**2).sum(axis=1)]

    def added(self, work: Callable[[np.ndarray], np.ndarray], rows: int, width: int) -> np.ndarray:
        """Sum of work(centred rows), a rows x width matrix, over all rows, in one pass."""
        names, centred = [f"y{k}" for k in range(width)], self.centred

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((rows, width))
            for batch in batches:
                if batch.num_rows:
                    total += work(centred(matrix(batch.column(0), np.int64)))
            columns = [np.arange(rows), *total.T.copy()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", *names])

        schema = ", ".join(["at long", *(f"{y} double" for y in names)])
        parts = self.rows.select("x").mapInArrow(run, schema)
        sums = parts.groupBy("at").agg(*(F.sum(y).alias(y) for y in names)).toArrow()
        order = np.argsort(sums["at"].to_numpy())
        return np.stack([sums[y].to_numpy() for y in names], axis=1)[order]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}


def covariance_times(fit: FitList, q: np.ndarray) -> np.ndarray:
    """V Q for the covariance V of the fit list, by one pass over it."""
    return fit.added(lambda x: x.T @ (x @ q), fit.d, q.shape[1]) / fit.n


def filter_degree(theta: np.ndarray, wanted: int, cfg: WhitenConfig) -> tuple[int, float]:
    """Degree of the next filter and the upper end of the interval that it damps.

    High enough for the gain, as far as the spread allows: the last wanted vector must not drown in
    rounding errors of the first.
    """
    first, last = theta[0], max(theta[wanted - 1], 0.0)
    end = min(max(theta[-1], first * 1e-14), last * (1 - 1e-9), first * (1 - 1e-9))
    end = max(end, first * 1e-14)
    grow_first, grow_last = (np.arccosh(max(1.0, 2 * t / end - 1)) for t in (first, last))
    degree = cfg.max_degree
    if grow_last > 0:
        degree = min(degree, int(np.ceil(np.log(2 * cfg.gain) / grow_last)))
    if grow_first > grow_last:
        degree = min(degree, int(np.log(cfg.spread) / (grow_first - grow_last)))
    return max(degree, 1), end


def chebyshev(
    times: Callable[[np.ndarray], np.ndarray],
    q: np.ndarray,
    vq: np.ndarray,
    degree: int,
    end: float,
    first: float,
) -> np.ndarray:
    """The Chebyshev polynomial of V that is small on [0, end], scaled to 1 at `first`, times Q."""
    half = end / 2
    sigma = start = half / (first - half)
    before, now = q, (vq - half * q) * (start / half)
    for _ in range(degree - 1):
        new = 1 / (2 / start - sigma)
        before, now = now, (times(now) - half * now) * (2 * new / half) - sigma * new * before
        sigma = new
    return now


def eigenvectors(
    times: Callable[[np.ndarray], np.ndarray], d: int, cfg: WhitenConfig
) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest eigenvalues of V, their unit eigenvectors, and the certified residual.

    The residual is the largest |Vq - eq| over the largest eigenvalue. A block as wide as the space
    needs no filter. Directions without variance are left out.
    """
    wanted = min(cfg.components, d)
    width = min(d, wanted + cfg.guard)
    q = np.linalg.qr(np.random.default_rng(cfg.seed).normal(size=(d, width)))[0]
    best, stalls = np.inf, 0
    while True:
        vq = times(q)
        h = q.T @ vq
        theta, z = np.linalg.eigh((h + h.T) / 2)
        theta, z = theta[::-1], z[:, ::-1]
        q, vq = q @ z, vq @ z
        if theta[0] <= 0:
            return np.zeros(0), np.zeros((d, 0)), 0.0
        off = np.linalg.norm(vq - q * theta, axis=0)[:wanted].max() / theta[0]
        if off <= cfg.tolerance:
            break
        stalls = stalls + 1 if off > best / 2 else 0
        best = min(best, off)
        if stalls > 1 and off <= ROUNDING:
            break
        if stalls > 9:
            raise NotConverged(f"relative residual {off:.1e} after filtering")
        degree, end = filter_degree(theta, wanted, cfg)
        q = chebyshev(times, q, vq, degree, end, theta[0])
        q = np.linalg.qr(q / np.linalg.norm(q, axis=0))[0]
    kept = int((theta[:wanted] > NO_VARIANCE * theta[0]).sum())
    return theta[:kept], q[:, :kept], float(off)


def whiten(
    vectors: DataFrame,
    cfg: WhitenConfig | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """One row per vector and component: the vector whitened, and what the component explains.

    vec_id, component (from 1 by falling eigenvalue), n (vectors of the fit list), deviation
    (sum over dimensions of (n*x - S)^2, exact; NULL where that is no long), whitened, explained
    (share of the trace), identity_error (largest absolute entry of the whitened covariance minus
    the identity), residual (certified, relative to the largest eigenvalue).

    Vectors that are NULL, hold NULL or non-finite entries, or entries of 2^46 and more (at
    scale 64), are left out; zero vectors, rows with a NULL id and repeated rows take part like all others.
    The dimension is the most frequent length of the others, the larger one of a tie; vectors of
    another length are left out. Components without variance have no whitened values and are left out, so
    equal vectors, a single vector and an empty table give no rows. Equal eigenvalues may
    come as any basis of their space. Other columns are not looked at. The whole-number vectors
    are written to the shared folder; the result reads them there.
    """
    cfg = cfg or WhitenConfig()
    fit = FitList(materialize(whole_numbers(vectors, cfg, id_column, vector_column), "whole_vectors"))
    values, basis, residual = np.zeros(0), np.zeros((fit.d, 0)), 0.0
    trace = identity_error = 0.0
    if fit.d:
        trace = float(fit.added(lambda x: (x * x).sum(axis=0)[:, None], fit.d, 1).sum()) / fit.n
        values, basis, residual = eigenvectors(lambda q: covariance_times(fit, q), fit.d, cfg)
    to_white = basis / np.sqrt(values)
    k = len(values)
    if k:
        identity_error = _identity_error(fit, to_white)
    share = values / trace if k else values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, 1024):
                part = batch.slice(at, 1024)
                x, rows = matrix(part.column(1), np.int64), part.num_rows
                of_row = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(of_row),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, fit.n)),
                        pa.array(fit.deviations(x), pa.int64()).take(of_row),
                        pa.array((fit.centred(x) @ to_white).ravel()),
                        pa.array(np.tile(share, rows)),
                        pa.array(np.full(rows * k, identity_error)),
                        pa.array(np.full(rows * k, residual)),
                    ],
                    names=names,
                )

    kind = fit.rows.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double, residual double"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    return fit.rows.select("vec_id", "x").mapInArrow(run, schema)


def _identity_error(fit: FitList, to_white: np.ndarray) -> float:
    """Of the covariance of all whitened rows, by one pass."""
    k = to_white.shape[1]

    def work(x: np.ndarray) -> np.ndarray:
        w = x @ to_white
        return np.concatenate([w.T @ w, w.sum(axis=0)[:, None]], axis=1)

    sums = fit.added(work, k, k + 1) / fit.n
    mean = sums[:, k]
    return float(np.abs(sums[:, :k] - np.outer(mean, mean) - np.eye(k)).max())
