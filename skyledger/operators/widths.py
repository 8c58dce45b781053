"""The factor at which a robust width meets a target, found by narrowing rows as well as the factor.

Every row has a trajectory resid / hypot(err, scale * c) that shrinks towards zero
as the factor c grows, so over a bracket of factors it stays between its two ends.
Rows that lie clear of the median and of the wanted deviation all along the bracket
keep their side and are only counted; the others are candidates, and the equation
is solved on them alone. The median's own path is monotone too: it has one sign,
and all values of that sign shrink.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from skyledger.operators.cells import at_rank, between

_TOP = np.int64(2 ** 63 - 1)
_GREATEST = np.finfo(float).max
# Trajectories are monotone but for rounding.
SLACK = 1e-13


def image(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers."""
    bits = np.ascontiguousarray(x, dtype=float).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ _TOP)


def value(k: np.ndarray) -> np.ndarray:
    k = np.clip(k, image(np.array([-_GREATEST]))[0], image(np.array([_GREATEST]))[0])
    return np.where(k >= 0, k, k ^ _TOP).view(float)


def chi(resid: np.ndarray, err: np.ndarray, scale: np.ndarray, c: float) -> np.ndarray:
    return resid / np.hypot(err, scale * c)


@dataclass(frozen=True)
class Known:
    """What is settled of a group: its rows, the bracket, and the counts of rows that are no candidates."""

    n: int
    c_lo: float
    c_hi: float
    below: int = 0  # rows left out that lie below the median throughout
    inside: int = 0  # rows left out whose deviation is below ``least`` throughout
    least: float = 0.0
    most: float = np.inf

    @property
    def ranks(self) -> tuple[int, int]:
        return (self.n - 1) // 2, self.n // 2


def bounds(digits: np.ndarray, counts: np.ndarray, bits: int, known: Known) -> tuple[float, float, float, float]:
    """Least and greatest median, and least and greatest median deviation, of candidates counted by digit."""
    shift = 52 - bits
    order = np.argsort(digits)
    digits, n = digits[order], counts[order]
    lo, hi = value(digits << shift), value(((digits + 1) << shift) - 1)
    upto = np.cumsum(n)
    total = int(upto[-1])
    low, high = known.ranks
    m_lo = lo[np.searchsorted(upto, min(max(low - known.below, 0), total - 1), "right")]
    m_hi = hi[np.searchsorted(upto, min(max(high - known.below, 0), total - 1), "right")]
    near = np.maximum(0.0, np.maximum(lo - m_hi, m_lo - hi))
    far = np.maximum(hi - m_lo, m_hi - lo)

    def deviation(bound, rank):
        if rank < 0:
            return 0.0
        return at_rank(bound, n, rank) if rank < total else np.inf

    return float(m_lo), float(m_hi), deviation(near, low - known.inside), deviation(far, high - known.inside)


def candidates(resid, err, scale, c_lo: float, c_hi: float, m_lo: float, m_hi: float, least: float, most: float):
    """Which rows are candidates, and of the others which lie below the median and which deviate less than ``least``."""
    a, b = chi(resid, err, scale, c_lo), chi(resid, err, scale, c_hi)
    slack = SLACK * np.maximum(np.abs(a), np.abs(b))
    lo, hi = np.minimum(a, b) - slack, np.maximum(a, b) + slack
    near = np.maximum(0.0, np.maximum(lo - m_hi, m_lo - hi))
    far = np.maximum(hi - m_lo, m_hi - lo)
    keep = ((hi >= m_lo) & (lo <= m_hi)) | ((far >= least) & (near <= most))
    return keep, int((~keep & (hi < m_lo)).sum()), int((~keep & (far < least)).sum())


def solve(resid, err, scale, n, known: Known, target: float) -> float | None:
    """The factor in the bracket at which the median deviation is ``target``; None if the candidates cannot tell.

    Each candidate stands for ``n`` equal rows. At or beyond an end of the bracket, that end.
    """
    low, high = known.ranks

    def side(c: float) -> int | None:
        x = chi(resid, err, scale, c)
        a, b = _ranked(x, n, low - known.below, high - known.below)
        d = np.abs(x - between(a, b, 0.5 if low != high else 0.0))
        first, second = _ranked(d, n, low - known.inside, high - known.inside)
        if first > known.most or second < known.least:
            return 1 if first > known.most else -1
        if low != high and (first < known.least or second > known.most):
            return None
        return 1 if between(first, second, 0.5 if low != high else 0.0) > target else -1

    lo, hi = known.c_lo, known.c_hi
    while True:
        middle = lo + 0.5 * (hi - lo)
        if not lo < middle < hi or hi - lo <= 1e-13 * hi:
            return middle
        at = side(middle)
        if at is None:
            return None
        lo, hi = (middle, hi) if at > 0 else (lo, middle)


def _ranked(x: np.ndarray, n: np.ndarray, low: int, high: int) -> tuple[float, float]:
    """Values at two ranks; a rank before all of them is minus infinity, one beyond plus infinity."""
    order = np.argsort(x)
    upto = np.cumsum(n[order])
    total = upto[-1] if len(upto) else 0
    return tuple(-np.inf if r < 0 else np.inf if r >= total else float(x[order[np.searchsorted(upto, r, "right")]]) for r in (low, high))
