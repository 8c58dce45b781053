"""One row per key, as aggregates: a hot key collapses map-side before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions import exprs as x


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
              carry: dict[str, Column] | None = None) -> DataFrame:
    """The row with the smallest ``order`` per key.

    ``order`` must be total (end it with a row id) so that the pick does not
    depend on file order. ``carry`` adds aggregates such as the group size.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    extra = [expr.alias(name) for name, expr in (carry or {}).items()]
    return (df.groupBy(*keys).agg(best, *extra)
            .select(*keys, "__row.*", *(carry or {}).keys()).select(*df.columns, *(carry or {}).keys()))


def descending(value: str) -> list[Column]:
    """Sort terms for a number, largest first and missing last."""
    v = x.finite(F.col(value).cast("double"))
    return [v.isNull(), -v]


def ascending(value: str) -> list[Column]:
    v = x.finite(F.col(value).cast("double"))
    return [v.isNull(), v]


def keep_most_complete(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
                       row_id: Sequence[str]) -> DataFrame:
    """The row with the fewest missing values per key; ties go to the first row id."""
    missing = sum((F.when(x.is_finite(c), 0).otherwise(1) for c in columns[1:]),
                  F.when(x.is_finite(columns[0]), 0).otherwise(1))
    return keep_best(df, keys, [missing, *[F.col(c) for c in row_id]])


def keep_highest(df: DataFrame, keys: Sequence[str], value: str, row_id: Sequence[str]) -> DataFrame:
    return keep_best(df, keys, [*descending(value), *[F.col(c) for c in row_id]])


def keep_nearest(df: DataFrame, keys: Sequence[str], separation: str,
                 row_id: Sequence[str]) -> DataFrame:
    """Smallest separation per key, with the number of candidates it won against."""
    return keep_best(df, keys, [*ascending(separation), *[F.col(c) for c in row_id]],
                     carry={"n_in_radius": F.count(F.lit(1))})


def keep_first(df: DataFrame, keys: Sequence[str], row_id: Sequence[str]) -> DataFrame:
    return keep_best(df, keys, [F.col(c) for c in row_id])


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and rows a keep-one pass would drop."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
                       (F.sum("n") - F.count(F.lit(1))).alias("n_dropped"))


def claimed_by_many(df: DataFrame, item: str, group: str) -> DataFrame:
    """Items that appear in more than one group."""
    pairs = df.select(item, group).distinct()
    return (pairs.groupBy(item).agg(F.count(F.lit(1)).alias("n_groups"))
            .filter(F.col("n_groups") > 1))
