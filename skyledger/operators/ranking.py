"""Ordinal ranks without a single-task sort, and rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyledger.operators.quantiles import on_groups
from skyledger.session import stage


def ordinal_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], rank_col: str) -> DataFrame:
    """Add the 1-based row number within each group in a total order.

    Rows are range-partitioned on (group, order), numbered inside their partition,
    and shifted by the number of rows of the group in earlier partitions, so a
    group spreads over many tasks. ``order`` must end in a unique column.
    """
    by = list(by)
    # Written once: both the counts and the ranks must see the same partitioning.
    placed = stage(df.repartitionByRange(*by, *order)
                   .sortWithinPartitions(*by, *order)
                   .withColumn("__pid", F.spark_partition_id())
                   .withColumn("__pos", F.monotonically_increasing_id()
                               .bitwiseAND(F.lit((1 << 33) - 1))))
    runs = placed.groupBy("__pid", *by).agg(F.count(F.lit(1)).alias("__n"),
                                            F.min("__pos").alias("__first"))
    # At most (groups + partitions) rows: a group starts or ends in few partitions.
    earlier = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("__pid", *by, "__first",
                       F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    joined = on_groups(placed, runs, ["__pid", *by])
    return joined.withColumn(rank_col, F.col("__pos") - F.col("__first") + F.col("__shift") + 1
                             ).drop("__pid", "__pos", "__first", "__shift")


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, tie_break: Sequence[str]) -> DataFrame:
    """Rank correlation with ordinal ranks; ties follow ``tie_break`` (unique)."""
    by = list(by)
    ranked = ordinal_rank(df, by, [x, *tie_break], "__rx")
    ranked = ordinal_rank(ranked, by, [y, *tie_break], "__ry")
    rx, ry = F.col("__rx").cast("double"), F.col("__ry").cast("double")
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) > 1, F.corr(rx, ry)).alias("rho"))
