"""Leave-out folds: exact halves per stratum, and whole groups on one side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyledger.operators.quantiles import on_groups, select_rank


def seeded_hash(seed: int, *ids: str) -> Column:
    """Digest that orders rows at random but the same way in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.concat_ws("-", *ids)))


def exact_half_split(df: DataFrame, strata: Sequence[str], ids: Sequence[str], seed: int = 42,
                     out: str = "sample") -> DataFrame:
    """Fold A for exactly floor(n/2) rows of each stratum, B for the rest.

    The halves are the rows in order of a seeded digest. A stratum is never ordered
    on one task: the digest's leading 52 bits are cut at the rank n/2, and only the
    few rows that tie there are ordered by the full digest.
    """
    strata = list(strata)
    digest = seeded_hash(seed, *ids)
    order = Window.partitionBy(*strata).orderBy("__h", *ids)
    rows = df.withColumn("__h", digest).withColumn(
        "__w", F.conv(F.substring("__h", 1, 13), 16, 10).cast("double"))
    cut = select_rank(rows, strata, "__w", lambda n: n // 2)
    rows = on_groups(rows, cut.select(*strata, F.col("value").alias("__cut"),
                                      F.col("before").alias("__before"),
                                      F.floor(F.col("total") / 2).alias("__half")), strata)
    # Rank rows tied on the cut (a handful) by the full digest.
    take = F.when(F.col("__w") < F.col("__cut"), True).when(F.col("__w") > F.col("__cut"), False)
    rows = rows.withColumn("__take", take)
    decided = rows.filter(F.col("__take").isNotNull())
    close = rows.filter(F.col("__w") == F.col("__cut")).withColumn(
        "__take", F.col("__before") + F.row_number().over(order) <= F.col("__half"))
    both = decided.unionByName(close)
    fold = F.when(F.col("__take"), "A").otherwise("B")
    return both.withColumn(out, fold).drop("__h", "__w", "__cut", "__before", "__half", "__take")


def group_fold(group: str) -> Column:
    """Fold of a whole group from the CRC of its name."""
    return F.when(F.crc32(F.encode(F.col(group).cast("string"), "UTF-8")) % 2 == 0, "A").otherwise("B")


def reassign_groups(df: DataFrame, anchors: DataFrame, key: str, group: str,
                    sample: str = "sample") -> DataFrame:
    """Put every row of an anchor group in the group's fold; others keep theirs."""
    folds = anchors.select(F.col(key), group_fold(group).alias("__fold"))
    folds = folds.groupBy(key).agg(F.max("__fold").alias("__fold"))
    return (df.join(folds, key, "left")
            .withColumn(sample, F.coalesce("__fold", sample)).drop("__fold"))
