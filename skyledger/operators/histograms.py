"""Histograms, density grids and binned summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skyledger.functions import exprs as x
from skyledger.operators.evaluate import clean_catalog
from skyledger.operators.quantiles import medians, on_groups
from skyledger.operators.robust import robust_stats


def bin_table(df: DataFrame, nbins: int) -> DataFrame:
    """The bin numbers 0..nbins-1 as a table."""
    return df.sparkSession.range(nbins).select(F.col("id").cast("int").alias("bin"))


def histogram(df: DataFrame, by: Sequence[str], value: str, lo: float, hi: float, nbins: int,
              clip: bool = False) -> DataFrame:
    """Counts in equal bins with the last one closed; empty bins are listed.

    ``clip`` puts out-of-range values in the end bins, otherwise they are dropped.
    """
    by = list(by)
    v = x.finite(F.col(value).cast("double"))
    if clip:
        v = x.clip(v, lo, hi)
    # width_bucket puts hi itself past the end; the last bin is closed.
    number = F.least(F.width_bucket(v, F.lit(float(lo)), F.lit(float(hi)), F.lit(nbins)), F.lit(nbins)) - 1
    number = F.when((v >= lo) & (v <= hi) & F.col(value).isNotNull(), number)
    # Dropped rows count under no bin, so one scan gives the counts and the groups.
    counts = df.groupBy(*by, number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edge = (hi - lo) / nbins
    if by:
        groups = counts.select(*by).distinct().withColumn(
            "bin", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))))
    else:
        groups = bin_table(df, nbins)
    full = groups.join(counts, [*by, "bin"], "left").na.fill({"n": 0})
    return full.select(*by, "bin", (lo + F.col("bin") * edge).alias("bin_lo"),
                       (lo + (F.col("bin") + 1) * edge).alias("bin_hi"), "n")


def density_grid(df: DataFrame, x_col: str, y_col: str, x_step: float, y_step: float,
                 by: Sequence[str] = ()) -> DataFrame:
    """Row counts on a grid of rectangular cells, with log10 counts."""
    gx = F.floor(x.finite(x_col) / x_step)
    gy = F.floor(x.finite(y_col) / y_step)
    cells = df.select(*by, gx.alias("gx"), gy.alias("gy")).filter(
        F.col("gx").isNotNull() & F.col("gy").isNotNull())
    return cells.groupBy(*by, "gx", "gy").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "log_n", F.log10(F.col("n").cast("double")))


def sigma_limited_histogram(df: DataFrame, value: str, nbins: int = 100, sigma: float = 3.0) -> DataFrame:
    """Histogram of the values strictly inside mean +- sigma sample deviations.

    Bins run from the smallest to the largest value kept.
    """
    rows = df.select(x.finite(F.col(value).cast("double")).alias("v")).filter(F.col("v").isNotNull())
    stats = rows.agg(F.avg("v").alias("mu"), F.stddev_samp("v").alias("sd")).first()
    mu, sd = stats["mu"], stats["sd"]
    kept = rows.filter((F.col("v") > mu - sigma * sd) & (F.col("v") < mu + sigma * sd))
    ends = kept.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    return histogram(kept, [], "v", ends["lo"], ends["hi"], nbins)


def binned_mean_std(df: DataFrame, axis: str, value: str, nbins: int = 20) -> DataFrame:
    """Mean and sample deviation of ``value`` in equal-width bins of ``axis``.

    Half-open bins: the row at the maximum of the axis has no bin.
    """
    rows = df.select(x.finite(F.col(axis).cast("double")).alias("a"),
                     x.finite(F.col(value).cast("double")).alias("v")).filter(F.col("a").isNotNull())
    ends = rows.agg(F.min("a").alias("lo"), F.max("a").alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    width = (hi - lo) / nbins
    number = F.floor((F.col("a") - lo) / width).cast("int")
    return (rows.filter(F.col("a") < hi).groupBy(number.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("axis_mean"),
                 F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")))


def sigma_clip(df: DataFrame, columns: Sequence[str], sigma: float = 3.0,
               rounds: int = 5) -> tuple[DataFrame, list[dict]]:
    """Iterative clip about the median by the population deviation, per column.

    Each column clips on its own surviving values; a row stays if it survives in
    every column. Stops when a round removes nothing. Only scalar bounds travel to
    the driver. Returns the kept rows and the bounds of every round.
    """
    rows = df.filter(x.all_finite(list(columns)))
    bounds = {c: (float("-inf"), float("inf")) for c in columns}
    history = []

    def inside(c: str, b: tuple[float, float]):
        return F.col(c).cast("double").between(F.lit(b[0]), F.lit(b[1]))

    for _ in range(rounds):
        masked = rows.select(*[F.when(inside(c, bounds[c]), F.col(c).cast("double")).alias(c)
                               for c in columns])
        med = medians(masked, [], list(columns)).first()
        sd = masked.agg(*[F.stddev_pop(c).alias(c) for c in columns],
                        *[F.count(c).alias(f"n_{c}") for c in columns]).first()
        new = {c: (max(bounds[c][0], med[c] - sigma * sd[c]), min(bounds[c][1], med[c] + sigma * sd[c]))
               for c in columns}
        history.append({"n": {c: sd[f"n_{c}"] for c in columns}, "bounds": new})
        after = rows.agg(*[F.count_if(inside(c, new[c])).alias(c) for c in columns]).first()
        settled = all(after[c] == sd[f"n_{c}"] for c in columns)
        bounds = new
        if settled:
            break
    keep = rows
    for c in columns:
        keep = keep.filter(inside(c, bounds[c]))
    return keep, history


def residual_histograms(cats: dict[str, DataFrame], lo: float = -0.5, hi: float = 0.5,
                        nbins: int = 59, snr: float = 20.0) -> DataFrame:
    """Probe residual histograms of several catalogs side by side, with the scatter."""
    rows = None
    for label, cat in cats.items():
        one = clean_catalog(cat).filter(x.hi_snr("plx", "e_plx", snr)).select(
            F.lit(label).alias("label"), x.fractional_residual("plx_sp", "plx").alias("frac"))
        rows = one if rows is None else rows.unionByName(one)
    hist = histogram(rows, ["label"], "frac", lo, hi, nbins)
    spread = robust_stats(rows, ["label"], ["frac"]).select(
        "label", F.col("frac_med").alias("median"), F.col("frac_scatter").alias("robust_scatter"))
    return on_groups(hist, spread, ["label"])
