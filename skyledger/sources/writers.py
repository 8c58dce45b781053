"""Writers: result tables, per-cluster datasets, compaction and quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skyledger.session import stage


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def write_per_cluster(df: DataFrame, path: str, label: str = "cluster", rows_per_task: int = 1_000_000,
                      mode: str = "error") -> None:
    """One directory per cluster; clusters without rows never appear, rows without a cluster are left out.

    A cluster of more than ``rows_per_task`` rows that is also larger than an even share of
    one task gets as many writers as its size asks for, so that one big cluster does not
    sit on one task; all others end in one file each.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(label).isNotNull())
    sizes = stage(rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n")))
    total = sizes.agg(F.sum("__n").alias("n")).first()["n"] or 0
    each = max(rows_per_task, total / parts)
    large = sizes.where(F.col("__n") > each).select(label, F.ceil(F.col("__n") / each).alias("__splits"))
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != label]), F.coalesce("__splits", F.lit(1).cast("long")))
    keyed = rows.join(large, label, "left").withColumn("__s", spread).drop("__splits")
    # The number is fixed: a file costs more than its bytes tell, so tasks are not put together by them.
    keyed.repartition(parts, label, "__s").drop("__s").write.mode(mode).partitionBy(label).parquet(path)


def compact(spark: SparkSession, source: str, target: str, rows_per_file: int = 20_000,
            mode: str = "error") -> None:
    """Rewrite files as zstd files of exactly ``rows_per_file`` rows each, but for the last.

    Rows are numbered by file and place in it, which needs only a count per file,
    and those of one new file meet in one task.
    """
    rows = spark.read.parquet(source)
    names = rows.columns
    rows = rows.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__i"))
    numbered = rows.join(_file_starts(rows), "__f").withColumn("__to", F.floor((F.col("__start") + F.col("__i")) / rows_per_file))
    (numbered.repartition("__to").sortWithinPartitions("__to", "__f", "__i").select(*names)
     .write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(target))


def _file_starts(rows: DataFrame) -> DataFrame:
    """Per file ``__f`` the number of rows in files before it.

    Files are range-partitioned by name, added up inside their partition and shifted
    by the partitions before, so no task sees the whole list.
    """
    # Written once: both sums must see the same partitions.
    files = stage(rows.groupBy("__f").agg(F.count(F.lit(1)).alias("__n")).repartitionByRange("__f")
                  .withColumn("__p", F.spark_partition_id()))
    inside = F.sum("__n").over(Window.partitionBy("__p").orderBy("__f")) - F.col("__n")
    sums = files.groupBy("__p").agg(F.sum("__n").alias("__n"))  # a row per partition
    shifts = sums.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__shift"))
    return files.withColumn("__inside", inside).join(shifts, "__p").select("__f", (F.col("__inside") + F.col("__shift")).alias("__start"))


def write_with_quarantine(df: DataFrame, ok: Column, path: str, failed_path: str,
                          input_columns: Sequence[str], mode: str = "error") -> None:
    """Good rows to ``path``; failed ones, with their input columns only, to ``failed_path``.

    The second table has the schema of the input and can be fed straight back in.
    """
    both = stage(df.withColumn("__ok", F.coalesce(ok, F.lit(False))))  # the work is done once
    both.filter("__ok").drop("__ok").write.mode(mode).parquet(path)
    both.filter("NOT __ok").select(*input_columns).write.mode(mode).parquet(failed_path)
