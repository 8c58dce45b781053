"""Sky geometry as column expressions (degrees in, degrees out)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from skyledger.functions.exprs import ColumnLike, col, wrap_degrees

# North galactic pole (J2000) and galactic longitude of the pole.
NGP_RA, NGP_DEC, NCP_L = 192.85948, 27.12825, 122.93192


def separation(ra1: ColumnLike, dec1: ColumnLike, ra2: ColumnLike, dec2: ColumnLike) -> Column:
    """Great-circle distance by the haversine form, stable for small angles."""
    sd = F.sin(F.radians(col(dec2) - col(dec1)) / 2)
    sr = F.sin(F.radians(col(ra2) - col(ra1)) / 2)
    h = sd * sd + F.cos(F.radians(col(dec1))) * F.cos(F.radians(col(dec2))) * sr * sr
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def flat_separation(ra: ColumnLike, dec: ColumnLike, ra0: ColumnLike, dec0: ColumnLike) -> Column:
    """Flat-sky distance from a centre, scaled by its declination; RA wraps at 360."""
    return F.hypot(wrap_degrees(col(ra) - col(ra0)) * F.cos(F.radians(col(dec0))), col(dec) - col(dec0))


def galactic(ra: ColumnLike, dec: ColumnLike) -> tuple[Column, Column]:
    """Galactic longitude in [-180, 180) and latitude."""
    dra, d = F.radians(col(ra) - NGP_RA), F.radians(col(dec))
    sp, cp = math.sin(math.radians(NGP_DEC)), math.cos(math.radians(NGP_DEC))
    b = F.degrees(F.asin(F.sin(d) * sp + F.cos(d) * cp * F.cos(dra)))
    l_ncp = F.degrees(F.atan2(F.cos(d) * F.sin(dra),
                              F.sin(d) * cp - F.cos(d) * sp * F.cos(dra)))
    return wrap_degrees(NCP_L - l_ncp), b


def in_footprint(ra: ColumnLike, dec: ColumnLike, max_abs_b: float = 15.0, l_min: float = -70.0,
                 l_max: float = 25.0) -> Column:
    l, b = galactic(ra, dec)
    return (F.abs(b) < max_abs_b) & (l > l_min) & (l < l_max)


def in_box(ra: ColumnLike, dec: ColumnLike, ra0: ColumnLike, dec0: ColumnLike,
           radius: float) -> Column:
    """Inside the box around a centre, widened in RA by 1/cos(dec), wrapping at 360."""
    half = F.lit(float(radius)) / F.greatest(F.cos(F.radians(col(dec0))), F.lit(1e-6))
    off = F.abs(wrap_degrees(col(ra) - col(ra0)))
    return (off <= half) & (F.abs(col(dec) - col(dec0)) <= radius)
