"""Eigenvalues and eigenvectors of a scatter matrix, kept up to date by rank-one updates.

A ``Spectrum`` holds the number of vectors, their exact integer sums, and the
eigendecomposition of their centred scatter. Adding z z^T needs the roots of the
secular equation 1 + sum w_j^2 / (values_j - root) = 0, w being z in the present
basis; each lies between two neighbouring values. Components of z that are
negligible, and all but one component of equal values, are deflated first: their
pairs stay as they are.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps


class Spectrum:
    """Running eigendecomposition of sum (x - mean)(x - mean)^T over integer vectors."""

    def __init__(self, dim: int):
        self.n, self.sums = 0, [0] * dim
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    @classmethod
    def of(cls, n: int, sums, values, vectors) -> Spectrum:
        out = cls(len(sums))
        out.n, out.sums = int(n), [int(s) for s in sums]
        out.values = np.array(values, float)
        out.vectors = np.array(vectors, float).reshape(len(out.values), -1)
        return out

    def add(self, x: np.ndarray) -> None:
        """Take in the rows of an integer matrix.

        They are centred about their own mean and rotated among themselves into at
        most as many rows as there are dimensions, which leaves their scatter as it
        is; every one of those rows is an update, and so is the way between the means.
        """
        sums = [int(s) for s in x.sum(axis=0)]
        rows = centred(x, len(x), sums)
        if len(rows) > rows.shape[1]:
            rows = np.linalg.qr(rows, mode="r")
        self._join(len(x), sums, rows)

    def merge(self, other: Spectrum) -> None:
        """Take in another spectrum, one of its eigenpairs after the other."""
        self._join(other.n, other.sums, np.sqrt(np.maximum(other.values, 0.0))[:, None] * other.vectors.T)

    def _join(self, n: int, sums: list[int], rows: np.ndarray) -> None:
        if not n:
            return
        for row in rows:
            self.values, self.vectors = rank_one(self.values, self.vectors, row)
        if self.n:
            # Exact integers: the difference of the means does not suffer from their size.
            way = np.array([(a * n - b * self.n) / (self.n * n) for a, b in zip(self.sums, sums)])
            way *= math.sqrt(self.n / (self.n + n) * n)
            self.values, self.vectors = rank_one(self.values, self.vectors, way)
        self.n += n
        self.sums = [a + b for a, b in zip(self.sums, sums)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows of an integer matrix less the mean sums / n, each rounded once."""
    whole, rest = deviations(x, n, sums)
    return whole / n if rest is None else whole - rest


def deviations(x: np.ndarray, n: int, sums: list[int]):
    """(n * x - sums, None) exactly if it fits 62 bits, else (x less the mean's whole part, its fraction)."""
    floor = np.array([s // n for s in sums], np.int64)
    over = np.array([s % n for s in sums], np.int64)
    d = x - floor
    if not d.size or (int(np.abs(d).max()) + 1) * n < 2 ** 62:
        return d * n - over, None
    return d, over / n


def rank_one(values: np.ndarray, vectors: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of vectors diag(values) vectors^T + z z^T, values rising."""
    order = np.argsort(values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    w = vectors.T @ z
    norm = float(np.linalg.norm(w))
    tol = 8 * EPS * max(float(np.abs(values).max(initial=0.0)), norm * norm)
    if norm * norm <= tol * EPS or norm == 0.0:
        return values, vectors
    live = _deflate(values, vectors, w, tol / norm, tol)
    if not len(live):
        return values, vectors
    poles, w = values[live], w[live]
    near, step = _secular_roots(poles, w * w)
    # root_i - pole_j, from the pole next to the root so that no digits cancel.
    gap = (poles[near][:, None] - poles[None, :]) + step[:, None]
    # The update whose roots are exactly these; its vectors are orthogonal to rounding.
    between = poles[:, None] - poles[None, :]
    np.fill_diagonal(between, 1.0)
    w = np.sign(w) * np.exp(0.5 * (np.log(np.abs(gap)).sum(axis=0) - np.log(np.abs(between)).sum(axis=0)))
    turn = w[None, :] / gap
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    values, vectors = values.copy(), vectors.copy()
    vectors[:, live] = vectors[:, live] @ turn.T
    values[live] = poles[near] + step
    return values, vectors


def _deflate(values: np.ndarray, vectors: np.ndarray, w: np.ndarray, least: float, tol: float) -> np.ndarray:
    """Places that the update moves; ``w`` and ``vectors`` of nearly equal values are turned so that one of them carries all."""
    live: list[int] = []
    for j in range(len(w)):
        if abs(w[j]) <= least:
            w[j] = 0.0
            continue
        if live:
            i = live[-1]
            length = math.hypot(w[i], w[j])
            c, s = w[j] / length, w[i] / length
            if abs((values[j] - values[i]) * c * s) <= tol:
                # The pair i keeps no part of z; what the turn leaves off the diagonal is below the tolerance.
                low, high = vectors[:, i].copy(), vectors[:, j].copy()
                vectors[:, i], vectors[:, j] = c * low - s * high, s * low + c * high
                a, b = values[i], values[j]
                values[i], values[j] = c * c * a + s * s * b, s * s * a + c * c * b
                w[i], w[j] = 0.0, length
                live.pop()
        live.append(j)
    return np.array(live, int)


def _secular_roots(poles: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each root the index of the pole next to it and its signed distance from there.

    Bisection over the bit patterns of the distance, which are in the order of the
    numbers: every root to the last digit, however close to its pole.
    """
    k = len(poles)
    width = np.append(np.diff(poles), w2.sum())
    half = 0.5 * width

    def value(near, step):
        return 1.0 + (w2 / ((poles[None, :] - poles[near][:, None]) - step[:, None])).sum(axis=1)

    own = np.arange(k)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        right = value(own, half) < 0.0
        right[-1] = False
        near = np.where(right, own + 1, own)
        sign = np.where(right, -1.0, 1.0)
        reach = half.copy()
        reach[-1] = width[-1]
        low, high = np.zeros(k, np.int64), np.nextafter(reach, np.inf).view(np.int64).copy()
        apart = poles[None, :] - poles[near][:, None]
        while (high - low > 1).any():
            middle = low + (high - low) // 2
            step = sign * middle.view(np.float64)
            rising = 1.0 + (w2 / (apart - step[:, None])).sum(axis=1)
            # From the left pole f rises from minus infinity; from the right one it falls to the left from plus infinity.
            inward = np.where(right, rising > 0.0, rising < 0.0)
            low, high = np.where(inward, middle, low), np.where(inward, high, middle)
    return near, sign * high.view(np.float64)
