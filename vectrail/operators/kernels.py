"""NumPy kernels over Arrow batches. Sums run from the left in double precision, so a kernel's distance has the same
bits as the column expression of functions.distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from vectrail.types import Metric

SLACK = 1e-9
#: Distances that a task holds at once.
PAIRS = 1 << 22


def matrix(col: pa.Array, dtype=np.float64) -> np.ndarray:
    """An array-of-numbers column as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, 0), dtype)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(dtype)


def left_sum(terms: np.ndarray) -> np.ndarray:
    """Sum over the last axis, strictly from the left."""
    if terms.shape[-1] == 0:
        return np.zeros(terms.shape[:-1])
    return np.cumsum(terms, axis=-1)[..., -1]


def exact(a: np.ndarray, b: np.ndarray, metric: Metric) -> np.ndarray:
    """Distances of rows of b to a (or to rows of a)."""
    if metric is Metric.L2:
        return left_sum((a - b) * (a - b))
    dot = left_sum(a * b)
    if metric is Metric.DOT:
        return -dot
    scale = left_sum(a * a) * left_sum(b * b)
    with np.errstate(invalid="ignore", divide="ignore"):
        return -np.where(scale > 0, dot / np.sqrt(scale), 0.0)


def rough(q: np.ndarray, x: np.ndarray, metric: Metric) -> np.ndarray:
    """All distances by one matrix product; for picking candidates only."""
    dot = q @ x.T
    if metric is Metric.L2:
        return (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * dot
    if metric is Metric.DOT:
        return -dot
    scale = np.sqrt((q * q).sum(axis=1)[:, None] * (x * x).sum(axis=1)[None, :])
    with np.errstate(invalid="ignore", divide="ignore"):
        return -np.where(scale > 0, dot / scale, 0.0)


class TopK:
    """The k nearest of all rows seen for some queries, ties to smaller ids."""

    def __init__(self, q: np.ndarray, k: int, metric: Metric):
        self.q, self.k, self.metric = q, k, metric
        self.ids = [np.zeros(0, np.int64) for _ in q]
        self.distances = [np.zeros(0) for _ in q]
        self.bound = np.full(len(q), np.inf)

    def see(self, ids: np.ndarray, x: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """allowed: a matrix of queries by rows, where a query has a filter of its own."""
        if not len(ids) or not self.k or not len(self.q):
            return
        step = max(1, PAIRS // len(ids))
        for a in range(0, len(self.q), step):
            self._see(a, a + step, ids, x, None if allowed is None else allowed[a : a + step])

    def _see(self, first: int, last: int, ids: np.ndarray, x: np.ndarray, allowed: np.ndarray | None) -> None:
        near = rough(self.q[first:last], x, self.metric)
        if allowed is not None:
            near = np.where(allowed, near, np.inf)
        slack = SLACK * (1 + np.abs(near).max(axis=1, where=np.isfinite(near), initial=0))
        if near.shape[1] > self.k:
            own = np.partition(near, self.k - 1, axis=1)[:, self.k - 1]
        else:
            own = np.full(len(near), np.inf)
        limit = np.minimum(self.bound[first:last], own) + 2 * slack
        for j in np.flatnonzero((near <= limit[:, None]).any(axis=1)).tolist():
            i = first + j
            c = np.flatnonzero((near[j] <= limit[j]) & np.isfinite(near[j]))
            d = np.concatenate([self.distances[i], exact(self.q[i], x[c], self.metric)])
            at = np.concatenate([self.ids[i], ids[c]])
            order = np.lexsort((at, d))[: self.k]
            self.ids[i], self.distances[i] = at[order], d[order]
            if len(order) == self.k:
                self.bound[i] = d[order[-1]]

    def rows(self, q_ids: np.ndarray) -> pa.RecordBatch:
        n = [len(x) for x in self.ids]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate(self.ids) if n else np.zeros(0, np.int64)), pa.array(np.concatenate(self.distances) if n else np.zeros(0))],
            names=["q_id", "vector_id", "distance"],
        )
