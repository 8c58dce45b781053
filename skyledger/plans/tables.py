"""How the driver's tables stand in for the catalog roles, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.functions.exprs import rounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double so both engines print the same value."""
    return df.select(*[rounded(c, digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def line_id():
    """A text id that is unique per line whatever the keys' range."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"))


LINE_ID = "(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::BIGINT)"


def hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result catalog from ``lineitem``: positive parallaxes, nothing missing."""
    li = table(spark, sf_dir, "lineitem")
    base = F.col("l_extendedprice") / 20000.0
    return li.select(
        line_id().alias("sdss_id"),
        base.alias("plx"), (base * (F.col("l_tax") + 0.013)).alias("e_plx"),
        (base * (0.95 + F.col("l_discount") + (F.col("l_partkey") % 101 - 50) / 2000.0)).alias("plx_sp"),
        (base * (0.02 + F.col("l_quantity") / 1000.0)).alias("err_sp"),
        F.when(F.substring(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber")), 1, 1) < "8", "A")
         .otherwise("B").alias("sample"),
        (F.col("l_returnflag") != "R").alias("train"), F.col("l_suppkey").alias("cluster"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag",
        "l_linestatus", (F.col("l_quantity") * 8.0 - 20.0).alias("snr"))


HUB = f"""hub AS (
  SELECT {LINE_ID} AS sdss_id,
    l_extendedprice / 20000.0 AS plx,
    l_extendedprice / 20000.0 * (l_tax + 0.013::DOUBLE) AS e_plx,
    l_extendedprice / 20000.0 * (0.95::DOUBLE + l_discount + (l_partkey % 101 - 50) / 2000.0::DOUBLE) AS plx_sp,
    l_extendedprice / 20000.0 * (0.02::DOUBLE + l_quantity / 1000.0::DOUBLE) AS err_sp,
    CASE WHEN md5(l_orderkey || '-' || l_linenumber)[1] < '8' THEN 'A' ELSE 'B' END AS sample,
    l_returnflag <> 'R' AS train, l_suppkey AS cluster,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus,
    l_quantity * 8.0::DOUBLE - 20.0::DOUBLE AS snr
  FROM lineitem)"""


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hub with the catalog's edge rows: negative, NaN, null and zero values."""
    nan = F.lit(float("nan"))
    p = F.col("l_partkey")
    return hub(spark, sf_dir).withColumns({
        "plx": F.when(p % 97 == 0, nan).when(F.col("l_linenumber") == 7, -F.col("plx"))
                .otherwise(F.col("plx")),
        "e_plx": F.when(p % 83 == 0, F.lit(None)).otherwise(F.col("e_plx")),
        "err_sp": F.when(p % 89 == 0, 0.0).otherwise(F.col("err_sp")),
        "zeropoint": F.when(p % 19 == 0, nan).otherwise(-0.03 - (p % 7) / 1000.0),
        "r_med_photogeo_pc": F.when(p % 53 == 0, nan).otherwise(
            1000.0 / F.col("plx") * (0.9 + (F.col("l_orderkey") % 21) / 100.0)),
        "flags": F.when(F.col("l_orderkey") % 10 == 0, 1024).otherwise(0),
        "spectrum_ok": F.col("l_orderkey") % 41 != 0})


MESSY = HUB + """, messy AS (
  SELECT sdss_id,
    CASE WHEN l_partkey % 97 = 0 THEN 'nan'::DOUBLE WHEN l_linenumber = 7 THEN -plx ELSE plx END AS plx,
    CASE WHEN l_partkey % 83 = 0 THEN NULL ELSE e_plx END AS e_plx,
    plx_sp, CASE WHEN l_partkey % 89 = 0 THEN 0.0::DOUBLE ELSE err_sp END AS err_sp,
    sample, train, cluster, snr, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_returnflag, l_linestatus,
    CASE WHEN l_partkey % 19 = 0 THEN 'nan'::DOUBLE ELSE -0.03::DOUBLE - (l_partkey % 7) / 1000.0::DOUBLE END AS zeropoint,
    CASE WHEN l_partkey % 53 = 0 THEN 'nan'::DOUBLE
         ELSE 1000.0::DOUBLE / plx * (0.9::DOUBLE + (l_orderkey % 21) / 100.0::DOUBLE) END AS r_med_photogeo_pc,
    CASE WHEN l_orderkey % 10 = 0 THEN 1024 ELSE 0 END AS flags,
    l_orderkey % 41 <> 0 AS spectrum_ok
  FROM hub)"""

# The catalog guard in SQL: non-finite to null, for the four parallax columns.
CLEAN = MESSY + """, cat AS (
  SELECT * REPLACE (CASE WHEN isfinite(plx) THEN plx END AS plx,
    CASE WHEN isfinite(e_plx) THEN e_plx END AS e_plx,
    CASE WHEN isfinite(plx_sp) THEN plx_sp END AS plx_sp,
    CASE WHEN isfinite(err_sp) THEN err_sp END AS err_sp)
  FROM messy)"""


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of ``exprs.rounded``."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"


def fold_rows(source: str = "cat") -> str:
    """SQL twin of ``evaluate.with_folds``."""
    return f"""folds AS (SELECT *, 'all' AS fold FROM {source}
      UNION ALL SELECT *, sample AS fold FROM {source} WHERE sample IN ('A', 'B'))"""
