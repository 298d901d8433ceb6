"""The k nearest of a bounded set of points, by cells: a query looks at the cells around its own, in rings that widen until nothing nearer can lie beyond."""

from __future__ import annotations

import numpy as np


class Cells:
    """Points sorted by cells that hold about half of `k` of them each."""

    def __init__(self, x: np.ndarray, y: np.ndarray, k: int = 1):
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        self.x0, self.y0 = (float(v.min()) if len(v) else 0.0 for v in (self.x, self.y))
        wide, high = (float(np.ptp(v)) if len(v) else 0.0 for v in (self.x, self.y))
        share = max(k, 2) / 2 / max(len(self.x), 1)
        long = max(wide, high, 1e-12)
        self.size = max(np.sqrt(max(wide, long * share) * max(high, long * share) * share), long / 4096)
        self.nx, self.ny = int(wide / self.size) + 1, int(high / self.size) + 1
        cell = self._row(self.y) * self.nx + self._column(self.x)
        self.order = np.argsort(cell, kind="stable")
        self.start = np.searchsorted(cell[self.order], np.arange(self.nx * self.ny + 1))

    def _column(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.x0) / self.size), 0, self.nx - 1).astype(np.int64)

    def _row(self, y: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((y - self.y0) / self.size), 0, self.ny - 1).astype(np.int64)

    def nearest(self, qx: np.ndarray, qy: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and numbers of the k nearest points of each query (all points, if there are fewer), nearest first, the lower number first among equals."""
        qx, qy = np.asarray(qx, float), np.asarray(qy, float)
        k = min(k, len(self.x))
        d2, i = np.empty((len(qx), k)), np.empty((len(qx), k), np.int64)
        if not k or not len(qx):
            return d2, i
        cell = self._row(qy) * self.nx + self._column(qx)
        order = np.argsort(cell, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0, True])
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = order[a:z]
            row, column = divmod(int(cell[own[0]]), self.nx)
            ring = 1
            while True:
                low, high = max(column - ring, 0), min(column + ring, self.nx - 1)
                rows = range(max(row - ring, 0), min(row + ring, self.ny - 1) + 1)
                whole = low == 0 and high == self.nx - 1 and len(rows) == self.ny
                near = np.concatenate([self.order[self.start[r * self.nx + low] : self.start[r * self.nx + high + 1]] for r in rows])
                if len(near) >= k:
                    near.sort()
                    dist = (self.x[near] - qx[own, None]) ** 2 + (self.y[near] - qy[own, None]) ** 2
                    if k < len(near):
                        bound = np.partition(dist, k - 1, axis=1)[:, k - 1]
                    else:
                        bound = dist.max(axis=1)
                    if whole or (bound < (ring * self.size) ** 2).all():
                        break
                ring = ring * 2
            pick = np.argsort(dist, axis=1, kind="stable")[:, :k]
            d2[own], i[own] = np.take_along_axis(dist, pick, axis=1), near[pick]
        return d2, i
