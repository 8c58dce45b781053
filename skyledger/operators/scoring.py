"""Batch scoring with saved models: numpy forward passes over Arrow batches.

Model arrays live in feature space (a few MB) and travel with the task closure.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from skyledger.functions import exprs as x
from skyledger.operators.fit import LinearModel, _predict
from skyledger.operators.paths import fit_folds
from skyledger.operators.joins import attach_star_table
from skyledger.operators.robust import robust_stats
from skyledger.operators.selection import apply_zero_point, complete_bands, drop_failed_spectra
from skyledger.operators.spectra import _map, assemble_features, ln_flux, matrix
from skyledger.session import stage


def _double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def predict(df: DataFrame, model: LinearModel, carry: Sequence[str], features: str = "features",
            out: str = "plx_sp") -> DataFrame:
    """exp of the clipped linear predictor for every row."""
    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        a = (matrix(batch.column(features), len(model.mu)) - model.mu) / model.sd
        return [pa.array(_predict(np.hstack([np.ones((len(a), 1)), a]), model.theta))]

    return _map(df.select(*dict.fromkeys([*carry, features])), list(carry), [_double(out)], work)


def held_out_route(train: str = "train", sample: str = "sample") -> Column:
    """Training rows go to the other fold's model, all others to the full one."""
    return (F.when(F.col(train) & (F.col(sample) == "A"), "B")
            .when(F.col(train) & (F.col(sample) == "B"), "A").otherwise("all"))


def in_fold_route(train: str = "train", sample: str = "sample") -> Column:
    """Training rows go to their own fold's model (the optimistic twin)."""
    return (F.when(F.col(train) & (F.col(sample) == "A"), "A")
            .when(F.col(train) & (F.col(sample) == "B"), "B").otherwise("all"))


def predict_routed(df: DataFrame, models: Mapping[str, LinearModel], carry: Sequence[str],
                   model: str = "model", features: str = "features", out: str = "plx_sp") -> DataFrame:
    """Each row scored by the model it names, in one pass."""
    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        names = np.asarray(batch.column(model).to_pylist())
        values = matrix(batch.column(features))
        result = np.full(len(names), np.nan)
        for name, m in models.items():
            mine = names == name
            if mine.any():
                a = (values[mine] - m.mu) / m.sd
                result[mine] = _predict(np.hstack([np.ones((len(a), 1)), a]), m.theta)
        return [pa.array(result)]

    return _map(df.select(*dict.fromkeys([*carry, features, model])), list(carry), [_double(out)], work)


# --- networks ----------------------------------------------------------------------------
def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * v))


Layers = list[tuple[np.ndarray, np.ndarray]]


def mlp(layers: Layers, a: np.ndarray) -> np.ndarray:
    """SiLU network; every layer but the last is followed by the activation."""
    for w, b in layers[:-1]:
        h = a @ w + b
        a = h * _sigmoid(h)
    w, b = layers[-1]
    return a @ w + b


@dataclass(frozen=True)
class TwoHeadNet:
    """Body plus two linear heads: log-parallax and log spec error."""

    body: Layers
    head_mu: tuple[np.ndarray, np.ndarray]
    head_log_sigma: tuple[np.ndarray, np.ndarray]
    mu: np.ndarray
    sd: np.ndarray
    std_factor: float = 1.0


def predict_two_head(df: DataFrame, net: TwoHeadNet, carry: Sequence[str],
                     features: str = "features") -> DataFrame:
    """``plx_sp`` and ``err_sp`` (clamped sigma times the deviation factor)."""
    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        a = (matrix(batch.column(features), len(net.mu)) - net.mu) / net.sd
        for w, b in net.body:
            h = a @ w + b
            a = h * _sigmoid(h)
        z = (a @ net.head_mu[0] + net.head_mu[1]).ravel()
        s = (a @ net.head_log_sigma[0] + net.head_log_sigma[1]).ravel()
        sigma = np.exp(np.clip(s, x.LOG_SIGMA_MIN, x.LOG_SIGMA_MAX))
        return [pa.array(np.exp(np.clip(z, -x.Z_CLIP, x.Z_CLIP))), pa.array(sigma * net.std_factor)]

    return _map(df.select(*dict.fromkeys([*carry, features])), list(carry),
                [_double("plx_sp"), _double("err_sp")], work)


@dataclass(frozen=True)
class GatedNet:
    """Linear backbone, extinction term and a residual net switched off outside the hull.

    Features are ``[bands | extinction? | spectrum]``; ``n_bands`` counts the bands.
    """

    theta: np.ndarray
    bias: float
    phi: np.ndarray
    residual: Layers
    log_sigma: Layers
    mu: np.ndarray
    sd: np.ndarray
    components: np.ndarray
    scale: np.ndarray
    tau: float
    width: float
    n_bands: int
    has_extinction: bool = True
    extras: dict = field(default_factory=dict)


def predict_gated(df: DataFrame, net: GatedNet, carry: Sequence[str],
                  features: str = "features") -> DataFrame:
    """``plx_sp, err_sp, gate, hull_d`` of every row."""
    first = net.n_bands + int(net.has_extinction)

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        a = (matrix(batch.column(features), len(net.mu)) - net.mu) / net.sd
        scores = (a[:, first:] @ net.components) / net.scale
        hull = (scores ** 2).mean(axis=1)
        gate = _sigmoid((net.tau - hull) / net.width)
        z = a @ net.theta + net.bias
        if net.has_extinction:
            z = z + a[:, net.n_bands] * (a[:, :net.n_bands] @ net.phi)
        reduced = np.hstack([a[:, :first], scores])
        z = z + gate * mlp(net.residual, reduced).ravel()
        s = mlp(net.log_sigma, reduced).ravel() + np.log(0.1)
        return [pa.array(np.exp(np.clip(z, -x.Z_CLIP, x.Z_CLIP))),
                pa.array(np.exp(np.clip(s, x.LOG_SIGMA_MIN, x.LOG_SIGMA_MAX))),
                pa.array(gate), pa.array(hull)]

    return _map(df.select(*dict.fromkeys([*carry, features])), list(carry),
                [_double(c) for c in ("plx_sp", "err_sp", "gate", "hull_d")], work)


def require_same_bands(model_bands: Sequence[str], dataset_bands: Sequence[str]) -> None:
    """Refuse a model fitted on other bands."""
    if list(model_bands) != list(dataset_bands):
        raise ValueError(f"model bands {list(model_bands)} differ from dataset bands {list(dataset_bands)}")


# --- saved model on new spectra -------------------------------------------------------------
def features_of_spectra(spectra: DataFrame, stars: DataFrame, *, good: np.ndarray, bands: Sequence[str],
                        star_row_id: Sequence[str], masks: Mapping[str, np.ndarray] | None = None,
                        key: str = "sdss_id", f_max: float = 2.0, carry: Sequence[str] = ()) -> DataFrame:
    """Metadata and ``features`` of new spectra on the training-time pixels and bands.

    Membership columns such as ``memberprob`` and ``cluster`` are carried through
    when the spectra have them.
    """
    extra = [c for c in ("memberprob", "cluster", *carry) if c in spectra.columns]
    meta = attach_star_table(drop_failed_spectra(spectra), stars, key,
                             ["plx", "e_plx", *bands, "r_med_photogeo"], star_row_id)
    meta = complete_bands(meta, bands).withColumnRenamed("plx", "plx_raw")
    if "zeropoint" not in meta.columns:
        meta = meta.withColumn("zeropoint", F.lit(None).cast("double"))
    meta = apply_zero_point(meta)
    kept = [key, "plx", "e_plx", "plx_raw", "zeropoint", "r_med_photogeo", *bands, *extra]
    lnf = ln_flux(meta, list(dict.fromkeys(kept)), good=good, masks=masks, f_max=f_max)
    return lnf.withColumn("features", assemble_features(bands, "ln_flux")).drop("ln_flux", *bands)


def _catalog(scored: DataFrame) -> DataFrame:
    return scored.withColumn("dist_sp_kpc", x.distance_kpc("plx_sp")).withColumnRenamed(
        "r_med_photogeo", "r_med_photogeo_pc")


def apply_linear(spectra: DataFrame, stars: DataFrame, model: LinearModel, *, frac_sigma: float,
                 **options) -> DataFrame:
    """Result catalog for new spectra from a saved linear model."""
    rows = features_of_spectra(spectra, stars, **options)
    out = predict(rows, model, [c for c in rows.columns if c != "features"])
    return _catalog(out.withColumn("err_sp", F.col("plx_sp") * frac_sigma))


def apply_two_head(spectra: DataFrame, stars: DataFrame, net: TwoHeadNet, **options) -> DataFrame:
    """Result catalog for new spectra from a saved two-headed network."""
    rows = features_of_spectra(spectra, stars, **options)
    return _catalog(predict_two_head(rows, net, [c for c in rows.columns if c != "features"]))


# --- choice of the penalty ---------------------------------------------------------------------
def lambda_scan(rows: DataFrame, lams: Sequence[float], *, key: str, sample: str = "sample",
                snr: float = 20.0, **options) -> tuple[DataFrame, dict[float, dict[str, LinearModel]]]:
    """Held-out robust scatter for each penalty, and the fold models of each.

    Every fold is predicted by the other fold's model; the scatter is taken on the
    high signal-to-noise probe. All folds and penalties are fitted together, one scan
    a step. Only the probe is scored, without ``key``, and its residuals are written
    once for the passes that select from them.
    """
    models, scored = fit_folds(rows, lams, sample=sample, **options), None
    probe = rows.filter(x.hi_snr("plx", "e_plx", snr) & (F.col("plx") > 0)).withColumn(
        "model", F.when(F.col(sample) == "A", "B").otherwise("A"))
    for lam, fits in models.items():
        one = predict_routed(probe, fits, ["plx"], model="model").select(
            F.lit(float(lam)).alias("lam"), x.fractional_residual("plx_sp", "plx").alias("frac"))
        scored = one if scored is None else scored.unionByName(one)
    table = robust_stats(stage(scored), ["lam"], ["frac"]).select(
        "lam", F.col("frac_n").alias("n_probe"), F.col("frac_scatter").alias("scatter"))
    return table, models


def best_lambda(table: DataFrame) -> float:
    """Penalty with the least held-out scatter."""
    return table.agg(F.min_by("lam", "scatter").alias("lam")).first()["lam"]
