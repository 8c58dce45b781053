"""Order statistics from buckets: which buckets hold a rank, and which may hold a deviation's rank.

A cell is the distribution of one value in one group, as buckets (lowest value,
highest value, rows) that do not overlap. Ranks are known to lie in certain
buckets; those stay open and are looked into again, all others are settled and
run together. A cell is done once every bucket that matters is a single value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Cell:
    """What is known of a cell: ``lo, hi, n`` buckets in order, and which of them are ``open``."""

    lo: np.ndarray
    hi: np.ndarray
    n: np.ndarray
    open: np.ndarray
    total: int
    found: list[float] | None = None  # the values asked for, once no bucket is open
    before: int | None = None  # rows below the first of them

    @property
    def open_rows(self) -> int:
        return int(self.n[self.open].sum())


def between(a: float, b: float, share: float) -> float:
    """Linear interpolation that is exactly ``a`` when both are equal."""
    return a + (b - a) * share


def place(total: int, p: float) -> tuple[int, int, float]:
    """Ranks next to a quantile and the share of the way between them."""
    at = p * (total - 1)
    low = int(np.floor(at))
    return low, min(low + 1, total - 1), at - low


def at_rank(bound: np.ndarray, n: np.ndarray, rank: int) -> float:
    """The bound at a rank when every bucket stands ``n`` times."""
    order = np.argsort(bound, kind="stable")
    return float(bound[order[np.searchsorted(np.cumsum(n[order]), rank, "right")]])


def settle(lo, hi, n, probs=(), ranks=None, spread: bool = False) -> Cell:
    """Narrow a cell down to the buckets that can hold what is asked for.

    Asked for are the quantiles ``probs``, or the ``ranks`` (a function of the total)
    themselves; with ``spread``, also the median of the absolute deviations from the
    median, which comes last.
    """
    lo, hi, n = np.asarray(lo, float), np.asarray(hi, float), np.asarray(n, np.int64)
    order = np.lexsort((hi, lo))
    lo, hi, n = lo[order], hi[order], n[order]
    total = int(n.sum())
    if not total:
        return Cell(lo, hi, n, np.zeros(len(lo), bool), 0)
    upto = np.cumsum(n)
    single = lo == hi

    def bucket(rank: int) -> int:
        return int(np.searchsorted(upto, rank, "right"))

    wanted = [place(total, p) for p in probs] if ranks is None else [(r, r, 0.0) for r in ranks(total)]
    needed, nearer = np.zeros(len(lo), bool), np.zeros(len(lo), bool)
    for low, high, _ in wanted:
        needed[[bucket(low), bucket(high)]] = True
    deviation = None
    if spread:
        low, high, share = place(total, 0.5)
        i, j = bucket(low), bucket(high)
        needed[[i, j]] = True
        if single[i] and single[j]:
            centre = [between(lo[i], lo[j], share)] * 2
        else:
            centre = [lo[i], hi[j]]
        near = np.maximum(0.0, np.maximum(lo - centre[1], centre[0] - hi))
        far = np.maximum(hi - centre[0], centre[1] - lo)
        least, most = at_rank(near, n, low), at_rank(far, n, high)
        # Buckets surely nearer or surely farther than the rank are only counted.
        needed |= (far >= least) & (near <= most)
        nearer = far < least
        if single[needed].all():
            inside = int(n[far < least].sum())
            mine = needed & (far >= least) & (near <= most)
            deviation = between(at_rank(near[mine], n[mine], low - inside), at_rank(near[mine], n[mine], high - inside), share)
    open_ = needed & ~single
    if open_.any():
        return Cell(*_run_together(lo, hi, n, needed, nearer, open_), total)
    found = [between(float(lo[bucket(a)]), float(lo[bucket(b)]), share) for a, b, share in wanted]
    first = bucket(wanted[0][0]) if wanted else None
    return Cell(lo, hi, n, open_, total, found + ([deviation] if spread else []), None if first is None else int(upto[first] - n[first]))


def _run_together(lo, hi, n, needed, nearer, open_):
    """Neighbouring buckets that do not matter become one, unless the deviation's rank lies between them.

    A run of nearer and farther buckets would straddle that rank, and all its rows would be looked into again.
    """
    start = needed | np.r_[True, needed[:-1] | (nearer[1:] != nearer[:-1])]
    cuts = np.flatnonzero(start)
    return (np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.add.reduceat(n, cuts), open_[cuts])
