"""Row cuts, flags and derived catalog columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions import exprs as x

# Solution codes that carry a zero-point (5 and 6 parameters).
ASTROMETRIC_SOLUTIONS = (31, 95)


def complete_bands(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Rows whose every band is a finite number."""
    return df.filter(reduce(lambda a, b: a & b, [x.in_range(c) for c in bands]))


def drop_failed_spectra(df: DataFrame, flag: str = "spectrum_ok") -> DataFrame:
    """Rows with a spectrum; a table without the flag keeps every row."""
    return df.filter(F.col(flag)) if flag in df.columns else df


def training_flag(snr: str = "snr", flags: str = "spectrum_flags", plx: str = "plx",
                  err: str = "e_plx", snr_min: float = 100.0, override: str | None = None) -> Column:
    """Quality cuts only: no cut on the parallax or its significance.

    With ``override`` that column being positive replaces the snr and flag cuts;
    the finite-parallax guards still apply.
    """
    guards = x.is_finite(plx) & x.is_finite(err) & x.holds(F.col(err) > 0)
    if override is not None:
        return guards & x.holds(x.finite(F.col(override).cast("double")) > 0)
    return guards & x.holds(x.finite(snr) > F.lit(float(snr_min))) & x.holds(F.col(flags) == 0)


def sample_override(override: str, seeded: str) -> Column:
    """The override where it reads A or B, else the seeded fold."""
    value = F.trim(F.col(override).cast("string"))
    return F.when(value.isin("A", "B"), value).otherwise(F.col(seeded))


def zero_point_counts(df: DataFrame, plx: str = "plx_raw", zp: str = "zeropoint") -> DataFrame:
    return df.agg(F.count_if(x.is_finite(zp)).alias("n_applied"),
                  F.count_if(x.is_finite(plx) & ~x.is_finite(zp)).alias("n_without"))


def apply_zero_point(df: DataFrame, plx: str = "plx_raw", zp: str = "zeropoint",
                     out: str = "plx") -> DataFrame:
    """Corrected parallax; raw for all rows only if no row has a zero-point."""
    known = not df.filter(x.in_range(zp)).select(zp).isEmpty()
    corrected = x.corrected_parallax(plx, zp) if known else x.finite(plx)
    return df.withColumn(out, corrected)


def warm_start_rows(df: DataFrame, plx: str = "plx", err: str = "e_plx",
                    min_snr: float = 5.0) -> DataFrame:
    return df.filter(x.above(plx, 0) & x.above(err, 0)
                     & (x.ratio(plx, err) > F.lit(float(min_snr))))


def astrometric_solutions(df: DataFrame, col: str = "astrometric_params_solved") -> DataFrame:
    return df.filter(F.col(col).isin(*ASTROMETRIC_SOLUTIONS))


def clean_spectra(df: DataFrame, require_clean: bool = True, snr_min: float = 0.0,
                  flags: str = "spectrum_flags", snr: str = "snr") -> DataFrame:
    """Unflagged spectra, with an optional signal-to-noise floor."""
    if require_clean and flags in df.columns:
        df = df.filter(F.col(flags) == 0)
    if snr_min > 0 and snr in df.columns:
        df = df.filter(x.in_range(snr, lo=snr_min))
    return df


# Colour and gravity limits of the parent sample.
def colour_cut_jk(j: str, k: str, bp: str, rp: str) -> Column:
    return x.holds((F.col(j) - F.col(k)) < 0.4 + 0.45 * (F.col(bp) - F.col(rp)))


def colour_cut_hw2(h: str, w2: str) -> Column:
    return x.holds((F.col(h) - F.col(w2)) > -0.05)


def giant_gravity(logg: str) -> Column:
    g = x.finite(logg)
    return x.holds((g > 0) & (g <= 2.2))


def astrometric_quality(err: str, visibility: str, chi2: str, n_good: str) -> Column:
    """Error, visibility and reduced chi-square limits of the training sample."""
    red = x.ratio(chi2, F.sqrt(F.when(F.col(n_good) > 5, F.col(n_good) - 5)))
    return x.holds(x.finite(err) < 0.1) & x.holds(F.col(visibility) >= 8) & x.holds(red <= 35)


def flag_agreement(df: DataFrame, derived: Column, stored: Column) -> DataFrame:
    """How many rows the derived flag holds for and where both flags agree."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(derived).alias("n_derived"),
                  F.count_if(derived == x.holds(stored)).alias("n_agree"))


def membership_cut(df: DataFrame, prob: str, prob_min: float) -> DataFrame:
    """Members at or above the probability; unknown probability is dropped."""
    return df.filter(x.in_range(prob, lo=prob_min))


def range_view(df: DataFrame, **ranges: tuple[float | None, float | None]) -> DataFrame:
    """Open ranges per column, e.g. ``plx=(0, 2), teff=(None, 8000)``."""
    for name, (lo, hi) in ranges.items():
        if lo is not None and hi is not None:
            df = df.filter((F.col(name) > F.lit(float(lo))) & (F.col(name) < F.lit(float(hi))))
        elif lo is not None:
            df = df.filter(x.above(name, lo))
        elif hi is not None:
            df = df.filter(x.below(name, hi))
    return df


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its number of missing values, from one pass."""
    one = df.agg(*[F.count_if(~x.is_finite(F.col(c).cast("double"))).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns])).alias("r")
    ).select("r.*")


def sentinel_fallback(value: str, fallback: str, floor: float = -100.0) -> Column:
    """Positive value, else a finite fallback above ``floor``, else null; never <= 0."""
    alt = x.finite(fallback)
    picked = F.coalesce(F.when(x.holds(x.finite(value) > 0), F.col(value)),
                        F.when(alt > floor, alt))
    return F.when(picked > 0, picked)
