"""Which bands feed a model: a table of datasets, looked up by name or by band list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def spec(name: str, bands: Sequence[str], extinction: Sequence[str] = (), replaced: Mapping[str, str] | None = None,
         flagged: bool = False) -> dict[str, object]:
    """One row: ordered bands, the two bands of an extinction feature, bands read from an auxiliary table, survey flag."""
    return {"name": name, "bands": tuple(map(str, bands)), "extinction": tuple(extinction),
            "replaced": dict(replaced or {}), "flagged": flagged}


# The eight optical and infrared bands and the extinction pair.
DATASETS = [
    spec("dr17", ("g_mag", "bp_mag", "rp_mag", "j_mag", "h_mag", "k_mag", "w1_mag", "w2_mag"), extinction=("h_mag", "w2_mag")),
]


def lookup(name: str | None = None, bands: Sequence[str] | None = None) -> dict[str, object]:
    """The row called ``name``, else the one with these ``bands``, else a row of its own for the bands.

    A name alone must be known.
    """
    rows = {key: row for row in DATASETS for key in (row["name"], row["bands"])}
    found = [rows[key] for key in (name, None if bands is None else tuple(map(str, bands))) if key in rows]
    if found:
        return found[0]
    if bands is None:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(row['name'] for row in DATASETS)}")
    return spec("legacy", bands)


def feature_names(row: Mapping[str, object]) -> list[str]:
    """Columns of the feature array before the spectrum, in order."""
    names = list(row["bands"])
    if row["flagged"]:
        names.append("survey_ind")
    if row["extinction"]:
        names.append("extinction")
    return names


def dataset_table(spark: SparkSession, rows: Sequence[Mapping[str, object]] = DATASETS) -> DataFrame:
    """The datasets as rows of (dataset, bands)."""
    return spark.createDataFrame([(row["name"], list(row["bands"])) for row in rows], "dataset string, bands array<string>")


def resolve(models: DataFrame, datasets: DataFrame, name: str = "name", bands: str = "bands") -> DataFrame:
    """Each model with the ``dataset`` it was fitted on and that dataset's bands (``dataset_bands``).

    By name if a dataset is called so, else by an equal band list, else ``legacy`` with
    the model's own bands. A model with neither a known name nor bands has a null
    dataset. Datasets that share a band list count as their first by name.
    """
    by_name = datasets.select(F.col("dataset").alias("__name"), F.col("bands").alias("__named"))
    by_bands = datasets.groupBy(F.col("bands").alias("__bands")).agg(F.min("dataset").alias("__found"))
    joined = models.join(by_name, models[name] == F.col("__name"), "left").join(by_bands, models[bands] == F.col("__bands"), "left")
    own = F.when(F.col(bands).isNotNull(), F.lit("legacy"))
    return joined.withColumns({
        "dataset": F.coalesce("__name", "__found", own),
        "dataset_bands": F.coalesce("__named", "__bands", F.col(bands))}).drop("__name", "__named", "__bands", "__found")


def foreign_models(resolved: DataFrame, datasets: DataFrame, bands: str = "bands", target: str = "target") -> DataFrame:
    """Models with ``refused``: whether their bands differ, in names or order, from those of the dataset they are to score.

    A target that no dataset is called, or a model without bands, is refused.
    """
    wanted = datasets.select(F.col("dataset").alias("__target"), F.col("bands").alias("__wanted"))
    joined = resolved.join(wanted, resolved[target] == F.col("__target"), "left")
    return joined.withColumn("refused", ~F.coalesce(F.col(bands) == F.col("__wanted"), F.lit(False))).drop("__target", "__wanted")
