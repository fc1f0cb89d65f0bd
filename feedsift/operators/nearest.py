"""The k nearest of a block of vectors, exactly, at the price of one product in single precision.

Products of a tile of queries and vectors are made in single precision, and one comparison with each query's k-th value so far, widened by
the greatest error that the product can have, leaves few pairs; the distances of these are made in double precision and ranked.
So the answer is that of a ranking of all pairs in double precision, rounded to six digits, ties by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Distances are rounded to six digits before they are ranked, so a bound may be worse by this much.
SLACK = 2e-6
DIGITS = 6
#: Queries and vectors of a tile, columns that give a first k-th value, pairs found before they are ranked, and pairs whose distances are made at once.
_QUERIES, _WIDTH, _FIRST, _FOUND, _EXACT = 512, 2048, 1024, 1 << 17, 1 << 15
#: Rounding of one number in single precision; components above this would be squared out of its range.
_EPS, LARGEST = 2.0**-23, 1e15


def within(kth: np.ndarray) -> np.ndarray:
    """Keys up to these may be as near as ``kth`` when they are rounded."""
    return kth + SLACK * np.maximum(1, np.abs(np.where(np.isfinite(kth), kth, 1)))


def plain(x: np.ndarray) -> np.ndarray:
    """The rows that a block can take: finite, and not too large for single precision."""
    return (np.abs(x) <= LARGEST).all(1)                   # false for NaN


class Block:
    """Vectors in the order that breaks ties. ``metric`` is L2, L2_SQUARED, IP or COSINE (no vector or query without a direction then)."""

    def __init__(self, vectors: np.ndarray, metric: str):
        self.metric, self.desc, self.squares = metric, metric in ("IP", "COSINE"), metric in ("L2", "L2_SQUARED")
        self.v, self.sq = vectors, (vectors * vectors).sum(1)
        x = vectors / np.sqrt(self.sq)[:, None] if metric == "COSINE" else np.c_[vectors, self.sq] if self.squares else vectors
        self.reach = float(np.sqrt((x * x).sum(1).max(initial=0)))
        self.low = np.ascontiguousarray(x, np.float32)

    def nearest(self, q: np.ndarray, k: int, kth: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, positions, distances) for runs of queries: the k nearest of each, nearest first; with ``kth`` (a distance, or a
        similarity with its sign turned) only those whose key is at most that."""
        for i in range(0, len(q), _QUERIES):
            row, col, d = self._run(q[i:i + _QUERIES], min(k, len(self.v)), None if kth is None else kth[i:i + _QUERIES])
            yield row + i, col, d

    def _run(self, q: np.ndarray, k: int, kth: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = (q * q).sum(1)
        x = -q / np.sqrt(own)[:, None] if self.metric == "COSINE" else np.c_[-2 * q, np.ones(len(q))] if self.squares else -q
        add = own if self.squares else np.zeros(len(q))
        off = _EPS * (x.shape[1] + 4) * (np.sqrt((x * x).sum(1)) * self.reach + add)      # what a product may be wrong by
        low = x.astype(np.float32)

        def cut(key: np.ndarray, of=slice(None)) -> np.ndarray:
            """Products up to these may belong to pairs as near as ``key``."""
            w = within(key)
            return (w * w if self.metric == "L2" else w) - add[of] + off[of]

        most = np.full(len(q), np.inf) if kth is None else cut(kth)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        found, n = [], 0
        for a in range(0, len(self.low), _WIDTH):
            s = low @ self.low[a:a + _WIDTH].T
            unmet = np.flatnonzero(np.isposinf(most))
            if len(unmet) and s.shape[1] >= k:
                key = np.partition(s[unmet, :max(_FIRST, k)], k - 1, axis=1)[:, k - 1] + add[unmet] + off[unmet]
                most[unmet] = cut(np.sqrt(np.maximum(key, 0)) if self.metric == "L2" else key, unmet)
            hit = s <= np.nextafter(most.astype(np.float32), np.float32(np.inf))[:, None]
            at = _true(hit)
            found.append((at // s.shape[1], at % s.shape[1] + a))
            n += len(at)
            if n > _FOUND:
                best, found, n = self._rank(q, own, k, best, found), [], 0
                full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) == k)
                last = np.searchsorted(best[0], full, side="right") - 1
                most[full] = np.minimum(most[full], cut(-best[2][last] if self.desc else best[2][last], full))
        return self._rank(q, own, k, best, found)

    def _rank(self, q: np.ndarray, own: np.ndarray, k: int, best: tuple, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query of ``best`` and the pairs found."""
        row, col = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
        d = np.empty(len(row))
        for i in range(0, len(row), _EXACT):
            r, c = row[i:i + _EXACT], col[i:i + _EXACT]
            ip = np.einsum("ij,ij->i", q[r], self.v[c])
            if self.metric == "COSINE":
                ip /= np.sqrt(own[r]) * np.sqrt(self.sq[c])
            elif self.squares:
                ip = np.maximum(own[r] + self.sq[c] - 2 * ip, 0)
                ip = np.sqrt(ip) if self.metric == "L2" else ip
            d[i:i + _EXACT] = np.round(ip, DIGITS)
        row, col, d = (np.concatenate(x) for x in zip(best, (row, col, d)))
        order = np.lexsort((col, -d if self.desc else d, row))
        row = row[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[keep], col[order][keep], d[order][keep]


def _true(hit: np.ndarray) -> np.ndarray:
    """Positions of the few that are true, looked for eight at a time."""
    flat = hit.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    word, bit = np.nonzero(flat.reshape(-1, 8)[some])
    return some[word] * 8 + bit
