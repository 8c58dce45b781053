"""Robust grouped statistics: median, scaled MAD, inverse-variance mean, bins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.exprs import ColumnLike, col, finite, is_finite, holds
from skyledger.operators.quantiles import exact_quantiles, median_deviations, medians, on_groups

# Fixed value: the scale of the median absolute deviation.
MAD_SCALE = 1.48


def robust_stats(df: DataFrame, by: Sequence[str], values: Sequence[str],
                 extra: Sequence[Column] = (), total: tuple[str, str] | None = None) -> DataFrame:
    """Per group: ``<v>_n``, ``<v>_med`` and ``<v>_scatter`` (1.48 MAD) of each value.

    ``extra`` aggregates of the same groups are joined. All values share the passes,
    so a report over many metrics costs the same scans as one. Missing values
    (null, NaN, infinite) are left out of all three. ``total`` adds a group of all
    rows as in ``median_deviations``; ``extra`` then has no row for it.
    """
    by, values = list(by), list(values)
    spread = median_deviations(df, by, values, total)
    out = spread.select(*by, *[c for v in values for c in (
        F.col(f"{v}_n"), F.col(f"{v}_med"), (MAD_SCALE * F.col(f"{v}_mad")).alias(f"{v}_scatter"))])
    if not extra:
        return out
    clean = df.withColumns({v: finite(F.col(v).cast("double")) for v in values})
    return on_groups(out, clean.groupBy(*by).agg(*extra), by, how="left")


def inverse_variance(value: ColumnLike, err: ColumnLike) -> tuple[Column, Column]:
    """Aggregates: inverse-variance mean and its formal error (null when empty)."""
    ok = is_finite(value) & is_finite(err) & holds(col(err) > 0)
    w = F.when(ok, F.try_divide(F.lit(1.0), col(err) * col(err)))
    total = F.sum(w)
    return (F.try_divide(F.sum(w * col(value)), total),
            F.sqrt(F.try_divide(F.lit(1.0), total)))


def fraction(predicate: Column) -> Column:
    """Aggregate: share of rows where the predicate holds."""
    return F.avg(holds(predicate).cast("double"))


def numeric_summary(df: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per value: n, missing, mean, min, max and exact median; one row per value."""
    clean = df.select(*by, *[finite(v).alias(v) for v in values])
    long = clean.select(*by, F.explode(F.array(*[
        F.struct(F.lit(v).alias("column"), F.col(v).cast("double").alias("x"))
        for v in values])).alias("p")).select(*by, "p.column", F.col("p.x").alias("x"))
    keys = [*by, "column"]
    med = medians(long, keys, ["x"]).withColumnRenamed("x", "median")
    stats = long.groupBy(*keys).agg(
        F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("n_missing"),
        F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    return on_groups(stats, med, keys)


def quantile_bins(df: DataFrame, by: Sequence[str], axis: str, nbins: int, bin_col: str = "bin") -> DataFrame:
    """Attach ``bin`` 0..nbins-1 between linear quantile edges of ``axis`` per group.

    Bins are ``[e_i, e_i+1)`` and the top one has no upper edge. Rows without a
    finite axis value are dropped.
    """
    df = df.filter(F.col(axis).isNotNull())
    probs = [i / nbins for i in range(nbins + 1)]
    edges = exact_quantiles(df, by, [axis], probs, all_groups=False).withColumnRenamed(axis, "__edges")
    joined = on_groups(df, edges, list(by))
    below = [F.when(F.col(axis) >= F.col("__edges")[i], 1).otherwise(0) for i in range(nbins)]
    return joined.withColumn(bin_col, reduce(lambda a, b: a + b, below) - 1).drop("__edges")


def unique_edge_bins(df: DataFrame, by: Sequence[str], axis: str, nbins: int, bin_col: str = "bin") -> DataFrame:
    """As ``quantile_bins`` but repeated edges collapse and the largest row has no bin.

    Bins count from 1, as with half-open digitising; rows at or above the last
    edge are dropped.
    """
    df = df.filter(F.col(axis).isNotNull())
    probs = [i / nbins for i in range(nbins + 1)]
    edges = exact_quantiles(df, by, [axis], probs, all_groups=False).select(
        *by, F.array_distinct(axis).alias("__edges"))
    joined = on_groups(df, edges, list(by))
    below = [F.when(F.col(axis) >= F.get("__edges", F.lit(i)), 1).otherwise(0)
             for i in range(nbins + 1)]
    return (joined.withColumn(bin_col, reduce(lambda a, b: a + b, below))
            .filter(F.col(bin_col) < F.size("__edges")).drop("__edges"))
