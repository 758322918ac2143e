"""Distances of vectors: as column expressions and for whole batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

METRICS = ("l2", "manhattan", "cosine")


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def manhattan(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """1 less the cosine; null if either vector is zero."""
    dot = lambda x, y: _total(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")))
    return 1.0 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def register(spark: SparkSession) -> None:
    """l2_sq(a, b) for SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION l2_sq(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)")


def matrix(q: np.ndarray, r: np.ndarray, metric: str = "l2") -> np.ndarray:
    """Distances of all rows of q from all rows of r, in double, summed place by place."""
    q, r = q.astype(np.float64), r.astype(np.float64)
    if metric == "cosine":
        dot, qq, rr = np.zeros((len(q), len(r))), np.zeros(len(q)), np.zeros(len(r))
        for d in range(q.shape[1]):
            dot += q[:, d, None] * r[None, :, d]
            qq += q[:, d] ** 2
            rr += r[:, d] ** 2
        norm = np.sqrt(qq)[:, None] * np.sqrt(rr)[None, :]
        return np.where(norm > 0, 1.0 - dot / np.where(norm > 0, norm, 1.0), np.inf)
    out = np.zeros((len(q), len(r)))
    for d in range(q.shape[1]):
        step = q[:, d, None] - r[None, :, d]
        out += step * step if metric == "l2" else np.abs(step)
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return out


def paired(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Squared distances of each row of q from the row of r at the same place, summed place by place as ``matrix`` does."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        step = q[:, d] - r[:, d]
        out += step * step
    return out


def screened(q: np.ndarray, r: np.ndarray, k: int, limit: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs among which are the k nearest rows of r of each row of q by squared distance, ties included, that are no farther than its limit.

    A product of matrices leaves out what is surely too far; its error is far below
    the slack.  Where squares are too large for that, or no numbers, ``matrix`` decides.
    out: True where a pair does not count.
    """
    q, r = q.astype(np.float64, copy=False), r.astype(np.float64, copy=False)
    if not len(q) or not len(r):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    qq, rr = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", r, r)
    if qq.max() + rr.max() < 1e300:
        d = q @ r.T
        d *= -2.0
        d += qq[:, None]
        d += rr[None, :]
        slack = 1e-12 * (qq + rr.max() + 1.0)
    else:
        d, slack = matrix(q, r), np.zeros(len(q))
    if out is not None:
        d[out] = np.inf
    at = limit
    if len(r) > k and not np.isfinite(limit).all():
        at = np.fmin(limit, np.partition(d, k - 1, axis=1)[:, k - 1] + slack)  # fewer numbers than k: no bound
    i, j = np.nonzero(d <= (at + slack)[:, None])
    if out is not None:
        counts = ~out[i, j]
        i, j = i[counts], j[counts]
    return i, j
