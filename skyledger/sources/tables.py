"""Readers: column-pruned scans, schema checks and text member lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType)
ANCHOR_COLUMNS = ("sdss_id", "mu", "mu_err", "group")


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {sorted(df.columns)}")
    return df


def column_gaps(tables: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Per table its rows and the wanted columns that it lacks or holds only missing values in.

    One pass over each table; an empty list in both says that the table will do.
    """
    out = None
    for name, df in tables.items():
        there = [c for c in columns if c in df.columns]
        lacks = F.array(*[F.lit(c) for c in columns if c not in df.columns]).cast("array<string>")
        empty = F.array_compact(F.array(*[F.when(F.count(F.col(c)) == 0, F.lit(c)) for c in there]).cast("array<string>"))
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), empty.alias("empty")).select(
            F.lit(name).alias("table"), "n_rows", lacks.alias("lacks"), "empty")
        out = one if out is None else out.unionByName(one)
    return out


def scan(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan of the wanted columns only."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    return df if columns is None else require_columns(df, columns, str(path)).select(*dict.fromkeys(columns))


def scalar_columns(df: DataFrame, key: str, columns: Sequence[str] | None = None,
                   keep_nested: bool = False) -> DataFrame:
    """Without array, map and struct columns, unless some are asked for by name."""
    require_columns(df, [key, *(columns or [])])
    if columns:
        return df.select(*dict.fromkeys([key, *columns]))
    if keep_nested:
        return df
    return df.select(*[f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)])


def with_optional(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add absent columns with their default."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def spectra_metadata(df: DataFrame) -> DataFrame:
    """Scalar columns of a spectra table; no zero-point reads null, no flag reads ok."""
    full = with_optional(df, {"zeropoint": F.lit(None).cast("double"), "spectrum_ok": F.lit(True)})
    return require_columns(full, ["sdss_id", "snr", "spectrum_flags"], "spectra table").select(
        "sdss_id", "snr", "spectrum_flags", "zeropoint", "spectrum_ok")


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Test mode: the first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def result_catalog(df: DataFrame, names: Mapping[str, str], row_id: Sequence[str] = ()) -> DataFrame:
    """Catalog under the common names, with trimmed strings and defaults.

    ``names`` maps common to actual names. ``train`` defaults to true, ``sample`` to
    '?', and the id to one derived from the row's ``row_id`` columns.
    """
    need = ["plx", "e_plx", "plx_sp", "err_sp"]
    out = require_columns(df, [names.get(c, c) for c in need], "catalog")
    present = {c: names.get(c, c) for c in (*need, "train", "sample", "id") if names.get(c, c) in df.columns}
    exprs = {c: F.col(actual) for c, actual in present.items()}
    if "train" in exprs:
        exprs["train"] = exprs["train"].cast("boolean")
    for c in ("sample", "id"):
        if c in exprs:
            exprs[c] = F.trim(exprs[c].cast("string"))
    exprs.setdefault("train", F.lit(True))
    exprs.setdefault("sample", F.lit("?"))
    if "id" not in exprs:
        exprs["id"] = F.concat_ws("-", *row_id) if row_id else F.monotonically_increasing_id().cast("string")
    return out.select(*[e.alias(c) for c, e in exprs.items()])


def membership_text(spark: SparkSession, path: str | Sequence[str], suffix: str = ".txt") -> DataFrame:
    """Whitespace-separated member lists as (cluster, member_id, prob).

    The first field is a 64-bit id, the last one the probability, and ``#`` starts a
    comment. The cluster is the file name without its suffix.
    """
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.text(paths).select(
        F.trim(F.regexp_replace("value", "#.*", "")).alias("line"),
        file_label(suffix).alias("cluster")).filter(F.col("line") != "")
    parts = F.split("line", r"\s+")
    return lines.select("cluster", F.element_at(parts, 1).try_cast("bigint").alias("member_id"),
                        F.element_at(parts, -1).try_cast("double").alias("prob"))


def file_label(suffix: str) -> Column:
    """Label of a row from the name of its file."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "%20", " ")
    return F.regexp_replace(name, suffix.replace(".", r"\.") + "$", "")


def labelled_parquet(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str],
                     suffix: str = ".parquet") -> DataFrame:
    """Many Parquet files with a ``cluster`` column from each file's name."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = require_columns(spark.read.parquet(*paths), columns)
    return df.select(*columns, file_label(suffix).alias("cluster"))


def anchors(spark: SparkSession, path: str) -> DataFrame:
    """Anchor table from CSV or Parquet."""
    if path.rstrip("/").endswith(".csv"):
        df = spark.read.csv(path, header=True)
        require_columns(df, ANCHOR_COLUMNS, "anchor table")
        return df.select(F.col("sdss_id").cast("bigint").alias("sdss_id"), F.col("mu").cast("double").alias("mu"),
                         F.col("mu_err").cast("double").alias("mu_err"), F.col("group"))
    return require_columns(spark.read.parquet(path), ANCHOR_COLUMNS, "anchor table").select(*ANCHOR_COLUMNS)
