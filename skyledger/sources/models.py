"""Model tables with provenance: linear models as one row, networks as a row per named array."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skyledger.operators.fit import LinearModel
from skyledger.operators.scoring import GatedNet, TwoHeadNet
from skyledger.sources.datasets import feature_names, lookup

FOLDS = ("all", "A", "B")
_ARRAY = T.ArrayType(T.DoubleType())
SCHEMA = T.StructType(
    [T.StructField(f"{part}_{fold}", _ARRAY) for fold in FOLDS for part in ("theta", "mu", "sd")]
    + [T.StructField("good_pixels", T.ArrayType(T.BooleanType())),
       T.StructField("mask_telescopes", T.ArrayType(T.StringType())),
       T.StructField("mask_pixels", T.ArrayType(T.ArrayType(T.BooleanType()))),
       T.StructField("frac_sigma", T.DoubleType()), T.StructField("dataset", T.StringType()),
       T.StructField("bands", T.ArrayType(T.StringType())),
       T.StructField("photometry", T.ArrayType(T.StringType())),
       T.StructField("config", T.StringType())])


def _photometry(dataset: Mapping[str, object]) -> list[str]:
    return [c for c in feature_names(dataset) if c != "extinction"]


def save_linear(spark: SparkSession, path: str, models: Mapping[str, LinearModel], *, good: np.ndarray,
                frac_sigma: float, dataset: Mapping[str, object], config: Mapping[str, object],
                masks: Mapping[str, np.ndarray] | None = None, mode: str = "error") -> None:
    """Everything needed to score new rows without fitting again."""
    row: dict[str, object] = {}
    for fold in FOLDS:
        m = models.get(fold)
        for part in ("theta", "mu", "sd"):
            row[f"{part}_{fold}"] = [float(v) for v in getattr(m, part)] if m else None
    row["good_pixels"] = [bool(v) for v in good]
    row["mask_telescopes"] = list(masks) if masks else []
    row["mask_pixels"] = [[bool(v) for v in m] for m in masks.values()] if masks else []
    row["frac_sigma"], row["dataset"] = float(frac_sigma), dataset["name"]
    row["bands"], row["photometry"] = list(dataset["bands"]), _photometry(dataset)
    row["config"] = json.dumps(dict(config), sort_keys=True)
    spark.createDataFrame([tuple(row[f.name] for f in SCHEMA.fields)], SCHEMA).write.mode(mode).parquet(path)


def load_linear(spark: SparkSession, path: str) -> dict[str, object]:
    """Models by fold, pixel masks, dataset and settings of a saved model.

    Older tables may lack the dataset name or its column list.
    """
    df: DataFrame = spark.read.parquet(path)
    row = df.first().asDict()
    models = {f: LinearModel(*(np.array(row[f"{p}_{f}"]) for p in ("theta", "mu", "sd")))
              for f in FOLDS if row.get(f"theta_{f}") is not None}
    dataset = lookup(row.get("dataset"), row["bands"])
    names, pixels = row.get("mask_telescopes") or [], row.get("mask_pixels") or []
    return {"models": models, "good": np.array(row["good_pixels"], dtype=bool),
            "masks": {t: np.array(m, dtype=bool) for t, m in zip(names, pixels)} or None,
            "frac_sigma": row["frac_sigma"], "dataset": dataset, "bands": list(row["bands"]),
            "photometry": list(row.get("photometry") or _photometry(dataset)),
            "config": json.loads(row.get("config") or "{}")}


NETWORKS = {kind.__name__: kind for kind in (TwoHeadNet, GatedNet)}
NETWORK_SCHEMA = "name string, shape array<int>, values array<double>, text string"


def _flatten(name: str, value: object) -> list[tuple]:
    """Rows of one part of a network: arrays by name, layers by name and position, the rest as JSON."""
    if isinstance(value, np.ndarray):
        return [(name, list(value.shape), value.astype(float).ravel().tolist(), None)]
    if isinstance(value, (list, tuple)):
        return [row for k, part in enumerate(value) for row in _flatten(f"{name}.{k}", part)]
    return [(name, None, None, json.dumps(value, sort_keys=True))]


def save_network(spark: SparkSession, path: str, net: TwoHeadNet | GatedNet, *, dataset: Mapping[str, object],
                 config: Mapping[str, object], mode: str = "error") -> None:
    """Weights, standardisation, kind, bands and settings of a network."""
    rows = [row for f in dataclasses.fields(net) for row in _flatten(f"net.{f.name}", getattr(net, f.name))]
    rows += _flatten("kind", type(net).__name__) + _flatten("dataset", dataset["name"])
    rows += _flatten("bands", json.dumps(list(dataset["bands"]))) + _flatten("config", dict(config))
    spark.createDataFrame(rows, NETWORK_SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def load_network(spark: SparkSession, path: str) -> dict[str, object]:
    """The network with its dataset, bands and settings; older tables may lack the dataset's name."""
    parts: dict[str, object] = {}
    for r in spark.read.parquet(path).collect():  # one model's arrays
        parts[r["name"]] = json.loads(r["text"]) if r["text"] is not None else np.array(r["values"], dtype=float).reshape(r["shape"])
    bands = json.loads(parts["bands"])
    kind = NETWORKS[parts["kind"]]

    def part(name: str) -> object:
        if name in parts:
            return parts[name]
        inner = sorted({int(k[len(name) + 1:].split(".")[0]) for k in parts if k.startswith(f"{name}.")})
        found = [part(f"{name}.{k}") for k in inner]
        return tuple(found) if all(isinstance(v, np.ndarray) for v in found) else found

    net = kind(**{f.name: part(f"net.{f.name}") for f in dataclasses.fields(kind)})
    return {"net": net, "dataset": lookup(parts.get("dataset"), bands), "bands": bands, "config": parts["config"]}
