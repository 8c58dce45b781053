"""Scalar column expressions.

Missing values arrive as null or NaN, mixed. Spark orders NaN above every number
(``NaN > 100`` is true), so each predicate here first maps non-finite values to
null; null then fails every cut and is skipped by every aggregate.
"""

from __future__ import annotations

import math
import sys
from functools import reduce

from pyspark.sql import Column, functions as F

ColumnLike = Column | str

LOG_SIGMA_MIN, LOG_SIGMA_MAX = math.log(1e-4), math.log(10.0)
Z_CLIP = 30.0
LN10 = math.log(10.0)


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- guards -------------------------------------------------------------------
def is_finite(c: ColumnLike) -> Column:
    return finite(c).isNotNull()


# Comparisons for filters. Each is a conjunction of plain comparisons, which Catalyst
# pushes into the Parquet scan; NaN and infinities fail one side of it.
def in_range(c: ColumnLike, lo: float | None = None, hi: float | None = None) -> Column:
    """A finite number with lo <= c <= hi."""
    top = sys.float_info.max
    return (col(c) >= F.lit(float(-top if lo is None else lo))) & (
        col(c) <= F.lit(float(top if hi is None else hi)))


def above(c: ColumnLike, lo: float) -> Column:
    """A finite number greater than ``lo``."""
    return (col(c) > F.lit(float(lo))) & (col(c) <= F.lit(sys.float_info.max))


def below(c: ColumnLike, hi: float) -> Column:
    """A finite number less than ``hi``."""
    return (col(c) < F.lit(float(hi))) & (col(c) >= F.lit(-sys.float_info.max))


def finite(c: ColumnLike) -> Column:
    """The value where it is a finite number, else null.

    One comparison does it, because NaN sorts above every number; the short form
    keeps nested guards small enough to stay inside one compiled stage.
    """
    return F.when(F.abs(col(c)) <= F.lit(sys.float_info.max), col(c))


def all_finite(cols: list[ColumnLike]) -> Column:
    return reduce(lambda a, b: a & b, [is_finite(c) for c in cols])


def holds(predicate: Column) -> Column:
    """A predicate with null read as false."""
    return F.coalesce(predicate, F.lit(False))


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b for finite operands (see ``finite``); null when b is zero or NaN enters."""
    return F.nanvl(F.try_divide(col(a), col(b)).cast("double"), F.lit(None).cast("double"))


def rounded(c: ColumnLike, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


# --- maths --------------------------------------------------------------------
def clip(c: ColumnLike, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), col(c)))


def exp_clipped(z: ColumnLike) -> Column:
    return F.exp(clip(z, -Z_CLIP, Z_CLIP))


def sigmoid(x: ColumnLike) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def silu(x: ColumnLike) -> Column:
    return col(x) * sigmoid(x)


def log_add_exp(a: ColumnLike, b: ColumnLike) -> Column:
    a, b = col(a), col(b)
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def wrap_degrees(x: ColumnLike) -> Column:
    """Angle in [-180, 180)."""
    return F.pmod(col(x) + 180.0, F.lit(360.0)) - 180.0


# --- parallax space -----------------------------------------------------------
def corrected_parallax(plx: ColumnLike, zeropoint: ColumnLike) -> Column:
    return finite(plx) - finite(zeropoint)


def hi_snr(plx: ColumnLike, err: ColumnLike, threshold: float = 20.0) -> Column:
    """Evaluation probe: parallax over error at or above the threshold."""
    return holds(ratio(plx, err) >= F.lit(float(threshold)))


def fractional_residual(plx_sp: ColumnLike, plx: ColumnLike, offset: float = 0.0) -> Column:
    """(spec - (parallax + offset)) / parallax; positive means over-predicted."""
    return ratio(col(plx_sp) - (col(plx) + F.lit(float(offset))), plx)


def z_score(plx_sp: ColumnLike, plx: ColumnLike, err: ColumnLike, err_sp: ColumnLike,
            offset: float = 0.0) -> Column:
    """(spec - (parallax + offset)) under the two errors added in quadrature."""
    return ratio(col(plx_sp) - (col(plx) + F.lit(float(offset))), F.hypot(col(err), col(err_sp)))


def distance_kpc(plx_sp: ColumnLike) -> Column:
    return ratio(F.lit(1.0), plx_sp)


def pc_to_kpc(d: ColumnLike) -> Column:
    return col(d) / 1000.0


def distance_modulus(z: ColumnLike) -> Column:
    """Distance modulus of a log-parallax in mas."""
    return 10.0 - (5.0 / LN10) * col(z)


def log_precision_ratio(err: ColumnLike, err_sp: ColumnLike) -> Column:
    return F.log10(ratio(err, err_sp))


# The extinction relation A_Ks = 0.918 (H - W2 - 0.08).
RJCE_SLOPE, RJCE_INTRINSIC = 0.918, 0.08


def rjce_extinction(h: ColumnLike | None, w2: ColumnLike | None) -> Column:
    """Unclipped extinction proxy; null when the band pair is not available."""
    if h is None or w2 is None:
        return F.lit(None).cast("double")
    return RJCE_SLOPE * (col(h) - col(w2) - RJCE_INTRINSIC)


# --- per-row likelihood columns -----------------------------------------------
def _miss(mean: Column, seen: ColumnLike, *errors: ColumnLike | float) -> tuple[Column, Column]:
    """Squared miss of a mean and the variance of errors added in quadrature."""
    off = col(seen) - mean
    parts = [e if isinstance(e, Column) else F.lit(e) if isinstance(e, float) else col(e) for e in errors]
    return off * off, reduce(lambda a, b: a + b, [p * p for p in parts])


def _gauss(miss2: Column, var: Column) -> Column:
    """Negative log density of a Gaussian without its constant."""
    return 0.5 * (miss2 / var + F.ln(var))


def _by_variance(nll: Column, var: Column, beta: float) -> Column:
    """Each row weighted by its variance to the power ``beta``."""
    return nll * F.pow(var, F.lit(float(beta))) if beta > 0 else nll


def _sigma(z_log_sigma: ColumnLike) -> Column:
    return F.exp(clip(z_log_sigma, LOG_SIGMA_MIN, LOG_SIGMA_MAX))


def gaussian_nll(z_mu: ColumnLike, z_log_sigma: ColumnLike, plx: ColumnLike, err: ColumnLike,
                 beta: float = 0.0) -> Column:
    """Gaussian negative log-likelihood with the catalog error in the variance."""
    miss2, var = _miss(exp_clipped(z_mu), plx, _sigma(z_log_sigma), err)
    return _by_variance(_gauss(miss2, var), var, beta)


def student_t_nll(z_mu: ColumnLike, z_log_sigma: ColumnLike, plx: ColumnLike, err: ColumnLike,
                  nu: float) -> Column:
    """The same with heavier tails: the Gaussian's miss enters through its logarithm."""
    miss2, var = _miss(exp_clipped(z_mu), plx, _sigma(z_log_sigma), err)
    norm = math.lgamma(0.5 * nu) - math.lgamma(0.5 * nu + 0.5) + 0.5 * math.log(math.pi * nu)
    return norm + 0.5 * (F.ln(var) + (nu + 1.0) * F.log1p(miss2 / (nu * var)))


def mixture_nll(z: ColumnLike, sigma: ColumnLike, plx: ColumnLike, err: ColumnLike, *,
                zero_point: float, eps_logit: float, sigma_bad: float, beta: float = 0.0) -> Column:
    """Two Gaussians with one mean; the second is widened by ``sigma_bad``."""
    miss2, var = _miss(exp_clipped(z) + zero_point, plx, err, sigma)
    # Logarithms of the components' shares, and what each adds to the variance.
    parts = [(-math.log1p(math.exp(eps_logit)), 0.0), (-math.log1p(math.exp(-eps_logit)), sigma_bad * sigma_bad)]
    densities = [share - _gauss(miss2, var + more) for share, more in parts]
    return _by_variance(-reduce(log_add_exp, densities), var, beta)


def warm_gaussian_nll(z: ColumnLike, plx: ColumnLike, err: ColumnLike, frac: float = 0.08) -> Column:
    mean = exp_clipped(z)
    return _gauss(*_miss(mean, plx, err, frac * mean))


def anchor_nll(z: ColumnLike, mu: ColumnLike, mu_err: ColumnLike, floor: float) -> Column:
    return _gauss(*_miss(distance_modulus(z), mu, mu_err, float(floor)))


def penalty(theta_spectral: list[float], phi: list[float], residual: ColumnLike, *, l1_spectral: float,
            l1_phi: float, l2_residual: float) -> Column:
    """Aggregate: mean absolute coefficients plus the mean squared residual output."""
    def mean_abs(v: list[float]) -> float:
        return sum(abs(t) for t in v) / len(v)

    fixed = l1_spectral * mean_abs(theta_spectral) + l1_phi * mean_abs(phi)
    return F.lit(fixed) + l2_residual * F.avg(col(residual) * col(residual))


# --- identifiers --------------------------------------------------------------
def text_id(c: ColumnLike) -> Column:
    """An id as trimmed text; bytes are decoded as UTF-8, numbers written out, blanks are null."""
    text = F.trim(col(c).cast("string"))  # the cast reads bytes as UTF-8
    return F.when(text != "", text)


def prefixed_id(c: ColumnLike, prefix: str = "2M") -> Column:
    """The id as text with the survey's prefix, put in front unless it is there in either case."""
    text = text_id(c)
    there = F.upper(F.substring(text, 1, len(prefix))) == prefix.upper()
    return F.when(there, F.concat(F.lit(prefix), F.substring(text, len(prefix) + 1, 2 ** 31 - 1))).otherwise(F.concat(F.lit(prefix), text))
