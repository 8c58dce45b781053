"""The cluster chain: member spectra, their predictions, the labelled catalogue, one report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skyledger.operators.clusters import cluster_test, labelled_members, prepare_member_spectra
from skyledger.operators.fit import LinearModel
from skyledger.operators.scoring import predict
from skyledger.session import stage


def score_members(prepared: DataFrame, model: LinearModel, frac_sigma: float, carry: Sequence[str] = ()) -> DataFrame:
    """Prepared member spectra with the model's parallax and its quoted error, a fraction of it."""
    kept = dict.fromkeys(["cluster", "plx", "e_plx", *(c for c in ("memberprob",) if c in prepared.columns), *carry])
    return predict(prepared, model, list(kept)).withColumn("err_sp", F.col("plx_sp") * frac_sigma)


def cluster_chain(members: DataFrame, spectra: DataFrame, model: LinearModel, *, frac_sigma: float, key: str,
                  gaia_id: str, probs: DataFrame | None = None, prob_min: float = 0.9, row_id: Sequence[str] = (),
                  snr_min: float = 0.0, catalog: DataFrame | None = None, label: str = "cluster", offset: float = 0.0,
                  err_scale: float = 1.0, min_members: int = 5) -> DataFrame:
    """From member lists and spectra to the cluster report, in one call.

    The best clean spectrum of every probable member is scored with the saved model;
    ``catalog`` rows that carry a ``label`` (with ``plx, e_plx, plx_sp, err_sp``) join
    them, a star in both counting twice as it was measured twice; clusters meet by
    their name as text. The scored members are written once, the spectra are read once.
    """
    prepared = prepare_member_spectra(members, spectra, key=key, gaia_id=gaia_id, probs=probs, prob_min=prob_min,
                                      snr_min=snr_min, row_id=row_id)
    columns = ["cluster", "plx", "e_plx", "plx_sp", "err_sp"]
    both = stage(score_members(prepared, model, frac_sigma).withColumn("cluster", F.col("cluster").cast("string")).select(*columns))
    if catalog is not None:
        known = labelled_members(catalog, label).withColumn("cluster", F.col(label).cast("string"))
        both = both.unionByName(known.select(*columns))
    return cluster_test(both, offset=offset, err_scale=err_scale, min_members=min_members)
