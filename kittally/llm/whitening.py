"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. A pass over the distributed vectors multiplies the centred matrix and its
transpose with a thin block, X'(XQ): each task returns a block of dimensions x width, and Spark adds these up.
A polynomial of the covariance, built from such passes by the Chebyshev recurrence, damps everything below
the least Ritz value of the block. QR and Rayleigh-Ritz follow, until the residuals of the wanted pairs
are down to rounding and a fresh random block, filtered beside the found one, shows no larger eigenvalue. A
block that stays uncertified is widened; at full width Rayleigh-Ritz is exact, so the iteration always ends.

Vectors that are null or hold null or non-finite entries are left out, and so are those whose length is not
the most frequent one (the larger of two equally frequent ones). Repeated vectors count once in the fit
and are all whitened; rows keep a null or repeated key. Directions without variance have no unit scale:
components end where an eigenvalue is below 1e-10 of the trace, so a table with one distinct vector has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kittally.session import cut

COMPONENTS, GUARD, DEGREE, SCALE = 4, 28, 6, 256
TOLERANCE, TINY, FLAT, PATIENCE, STRIP = 1e-12, 1e-12, 1e-10, 3, 64


@dataclass
class Whitening:
    """What a fit knows: ``n`` distinct vectors, exact sums per dimension, unit eigenvectors as columns, eigenvalues, trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0
    passes: int = 0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integers(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x): entries as floor(256 c) of usable vectors of the most frequent length."""
    fine = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull()
        & F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    )
    usual = fine.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    fine = fine.where(F.size("v") == (usual["size"] if usual else 0))
    return fine.select("key", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).flatten().to_numpy().reshape(batch.num_rows, d)


def summed(fit: DataFrame, d: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all batches of what ``part`` makes of one; tasks add up their own before Spark adds them.

    A task sends its block in strips of up to ``STRIP`` columns, one row per dimension and strip.
    """
    strip = min(STRIP, shape[1])
    strips = -(-shape[1] // strip)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((shape[0], strips * strip))
        for x in matrices(batches, d):
            total[:, : shape[1]] += part(x)
        rows = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), strip).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), rows], names=["i", "v"])

    sums = [F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(strip)]
    out = np.zeros((shape[0] * strips, strip))
    for row in fit.mapInArrow(add, "i long, v array<double>").groupBy("i").agg(*sums).collect():
        out[row["i"]] = row[1:]
    return out.reshape(shape[0], strips * strip)[:, : shape[1]]


def filtered(apply: Callable, q: np.ndarray, aq: np.ndarray, top: float, cutoff: float, degree: int) -> np.ndarray:
    """Scaled Chebyshev polynomial of the covariance applied to q: below 1 on [0, cutoff], steep above it."""
    centre = half = cutoff / 2
    first = half / (top - centre)
    sigma = first
    before, now = q, (aq - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - centre * now) * (2 * following / half) - before * (sigma * following)
        sigma = following
    return now


def leading(apply: Callable, d: int, wanted: int, trace: float) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a positive semidefinite operator on d dimensions and their unit vectors."""
    rng = np.random.default_rng(13)
    width = min(d, wanted + GUARD)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    audited = rounds = 0
    while True:
        aq = apply(q)
        theta, turn = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        q, aq = q @ turn, aq @ turn
        gaps = np.linalg.norm(aq[:, :wanted] - q[:, :wanted] * theta[:wanted], axis=0)
        small = gaps.max() <= TOLERANCE * max(theta[0], 0.0)
        if width == d or not trace or (small and audited):
            return theta[:wanted], q[:, :wanted]
        rounds += 1
        audited = int(small)
        if rounds % PATIENCE == 0 and not small:
            width = min(d, 2 * width)
        cutoff = max(theta[-1], TINY * theta[0])
        if theta[0] - cutoff > TINY * theta[0]:
            q = filtered(apply, q, aq, theta[0], cutoff, DEGREE)
        fresh = width - q.shape[1] + (GUARD // 2 if small else 0)
        if fresh:  # wider, or the audit: random columns, filtered alike, must not find a larger eigenvalue
            start = rng.standard_normal((d, fresh))
            start -= q @ np.linalg.lstsq(q, start, rcond=None)[0]
            start = np.linalg.qr(start)[0]
            if theta[0] - cutoff > TINY * theta[0]:
                start = filtered(apply, start, apply(start), theta[0], cutoff, DEGREE)
            q = np.hstack([q[:, : width - fresh], start])
        q = np.linalg.qr(q / np.linalg.norm(q, axis=0))[0]


def fit(points: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of integer vectors ``x``, each distinct one counted once; None without vectors."""
    distinct = cut(points.select("x").distinct())
    size = distinct.select(F.size("x").alias("d"), F.lit(1).alias("one")).groupBy("d").agg(F.count("one").alias("n")).first()
    if size is None or not size["d"]:
        return None
    d, n = size["d"], size["n"]
    entries = distinct.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"))
    sums = [int(r["s"]) for r in sorted(entries.collect(), key=lambda r: r["i"])]
    done = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    mean = done.mean
    done.trace = float(summed(distinct, d, (1, 1), lambda x: np.array([[np.square(x - mean).sum()]]))[0, 0]) / n

    def apply(q: np.ndarray) -> np.ndarray:
        done.passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return summed(distinct, d, q.shape, part) / n

    values, vectors = leading(apply, d, min(components, d), done.trace)
    keep = int(np.sum(values > FLAT * done.trace))
    done.values, done.vectors = values[:keep], vectors[:, :keep]
    if keep:
        scaled = done.vectors / np.sqrt(done.values)

        def outer(x: np.ndarray) -> np.ndarray:
            white = (x - mean) @ scaled
            return white.T @ white

        done.identity_error = float(np.abs(summed(distinct, d, (keep, keep), outer) / n - np.eye(keep)).max())
    return done


def whiten(points: DataFrame, model: Whitening | None) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per vector and component."""
    schema = f"key {points.schema['key'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return points.sparkSession.createDataFrame([], schema)
    n, d, k = model.n, len(model.sums), len(model.values)
    mean, scaled = model.mean, model.vectors / np.sqrt(model.values)
    sums, explained, wrong = model.sums, model.values / model.trace, model.identity_error
    into = points.schema["key"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(sums, dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, d)
            reach = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums))
            if reach * reach * d < 1 << 63:
                off = n * x - np.array(sums, dtype=np.int64)
                deviation = pa.array((off * off).sum(axis=1))
            else:  # exact in Python; more than a long holds ends the query
                deviation = pa.array([int(((n * row.astype(object) - exact) ** 2).sum()) for row in x], pa.int64())
            white = ((x - mean) @ scaled).ravel()
            rows = np.repeat(np.arange(batch.num_rows), k)
            turn = np.tile(np.arange(k), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(pa.array(rows)),
                    pa.array(turn + 1, pa.int32()),
                    pa.array(np.full(len(rows), n)),
                    deviation.take(pa.array(rows)),
                    pa.array(white),
                    pa.array(explained[turn]),
                    pa.array(np.full(len(rows), wrong)),
                ],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return points.select("x", F.col("key").cast(into).alias("key")).mapInArrow(project, schema)


def whitening(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Fit on the distinct vectors of a table and whiten all of them."""
    points = cut(integers(rows, vector, key))
    return whiten(points, fit(points, components)).withColumnRenamed("key", key)
