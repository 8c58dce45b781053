"""Cluster validation: members share one distance, so their spread tests the errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from skyledger.functions import exprs as x
from skyledger.operators import selection
from skyledger.operators.dedup import keep_highest
from skyledger.operators.quantiles import medians, on_groups
from skyledger.operators.ranking import ordinal_rank
from skyledger.operators.robust import inverse_variance, robust_stats
from skyledger.operators.joins import membership_probability
from skyledger.session import stage

# Reference parallaxes of well-studied clusters, in mas.
REFERENCE_PARALLAX = {
    "M67": 1.17, "NGC2682": 1.17, "NGC6791": 0.23, "NGC6819": 0.42, "NGC7789": 0.50,
    "M71": 0.25, "NGC6838": 0.25, "M107": 0.156, "NGC6171": 0.156,
}

# Centre (deg), radius (deg), proper motion and tolerance (mas/yr).
CLUSTER_CENTRES = [
    ("M67", 132.846, 11.814, 1.00, -10.97, -2.94, 1.0),
    ("M71", 298.444, 18.779, 0.50, -3.41, -2.61, 1.0),
    ("M107", 248.133, -13.054, 0.50, -1.93, -5.98, 1.0),
]


def labelled_members(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Rows that carry a cluster label."""
    return df.filter(F.col(label).isNotNull())


def load_members(table: DataFrame, cluster: str, member_id: str, prob: str, prob_min: float,
                 id_as: str) -> DataFrame:
    """A published member table as (cluster, id), cut on probability."""
    cut = selection.membership_cut(table, prob, prob_min)
    return cut.select(F.col(cluster).alias("cluster"), F.col(member_id).alias(id_as))


def cluster_metrics(df: DataFrame, by: Sequence[str] = ("cluster",), *, offset: float = 0.0,
                    err_scale: float | str = 1.0) -> DataFrame:
    """Coherence and bias of each cluster's members.

    ``err_scale`` multiplies the quoted error first; a column name scales per row.
    """
    by = list(by)
    scale = F.col(err_scale) if isinstance(err_scale, str) else F.lit(float(err_scale))
    rows = df.select(*by, x.finite("plx_sp").alias("sp"), (x.finite("err_sp") * scale).alias("err"),
                     x.finite("plx").alias("a"), x.finite("e_plx").alias("ea"))
    rows = rows.withColumn("good", x.holds(F.col("sp").isNotNull() & (F.col("err") > 0)))
    sp_mean, sp_err = inverse_variance("sp", "err")
    a_mean, a_err = inverse_variance("a", "ea")
    # A row per group and used three times: written once.
    means = stage(rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_matched"), F.count_if("good").alias("n"),
        sp_mean.alias("sp_mean"), sp_err.alias("sp_mean_err"),
        a_mean.alias("gaia_mean"), a_err.alias("gaia_mean_err")))
    scored = on_groups(rows.filter("good"), means.select(*by, "sp_mean"), by)
    scored = scored.select(*by, "sp", ((F.col("sp") - F.col("sp_mean")) / F.col("err")).alias("chi"))
    spread = robust_stats(scored, by, ["sp", "chi"], extra=[F.avg(F.col("chi") * F.col("chi")).alias("internal_chi2")])
    out = on_groups(means, spread, by, how="left")
    diff = F.col("sp_mean") - F.col("gaia_mean") - F.lit(float(offset))
    comb = F.hypot(F.col("sp_mean_err"), F.col("gaia_mean_err"))
    return out.select(
        *by, "n_matched", "n", "sp_mean", "sp_mean_err", "gaia_mean", "gaia_mean_err",
        x.ratio(diff, "gaia_mean").alias("sp_vs_gaia_fracdiff"),
        x.ratio(diff, comb).alias("sp_vs_gaia_sigma"), F.col("sp_scatter").alias("tightness_mas"),
        x.ratio("sp_scatter", "sp_mean").alias("tightness_frac"), "internal_chi2",
        (F.col("chi_scatter") * F.col("chi_scatter")).alias("internal_robust_chi2"))


def cluster_test(df: DataFrame, *, label: str = "cluster", offset: float = 0.0,
                 err_scale: float = 1.0, min_members: int = 5,
                 reference: Mapping[str, float] = REFERENCE_PARALLAX) -> DataFrame:
    """Metrics of every cluster with enough matched members, largest first.

    Reference parallaxes are looked up by the upper-case, space-free name.
    """
    rows = labelled_members(df, label).withColumn("cluster", F.col(label).cast("string"))
    out = cluster_metrics(rows, ["cluster"], offset=offset, err_scale=err_scale)
    out = out.filter(F.col("n_matched") >= min_members)
    table = F.create_map(*[F.lit(v) for kv in reference.items() for v in kv])
    name = F.replace(F.upper("cluster"), F.lit(" "), F.lit(""))
    out = out.withColumn("lit_plx", F.try_element_at(table, name))
    out = out.withColumn("sp_vs_lit_fracdiff",
                         x.ratio(F.col("sp_mean") - F.col("lit_plx"), "lit_plx"))
    return out.orderBy(F.desc("n_matched"), "cluster")


def internal_chi2_summary(metrics: DataFrame) -> DataFrame:
    """Median internal chi-square over clusters; its root is an error factor."""
    return medians(metrics, [], ["internal_chi2"]).select(
        F.col("internal_chi2").alias("median_internal_chi2"),
        F.sqrt("internal_chi2").alias("recal_factor"))


def err_scale_sweep(df: DataFrame, scales: Sequence[float], label: str = "cluster") -> DataFrame:
    """Cluster metrics re-scored at several error scales (above 0), one row per (scale, cluster).

    A common scale leaves the weighted mean and the tightness alone and divides
    every chi, so the members are scored once and the few results are scaled.
    """
    if not all(s > 0 for s in scales):
        raise ValueError("error scales must be above 0")
    once = cluster_metrics(labelled_members(df, label), [label])
    each = once.withColumn("err_scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    s = F.col("err_scale")
    return each.withColumns({
        "sp_mean_err": F.col("sp_mean_err") * s,
        "sp_vs_gaia_sigma": x.ratio(F.col("sp_vs_gaia_fracdiff") * F.col("gaia_mean"),
                                    F.hypot(F.col("sp_mean_err") * s, F.col("gaia_mean_err"))),
        "internal_chi2": F.col("internal_chi2") / (s * s),
        "internal_robust_chi2": F.col("internal_robust_chi2") / (s * s)}).select("err_scale", *once.columns)


def member_chi(df: DataFrame, row_id: str, label: str = "cluster") -> DataFrame:
    """Members by falling |chi| about their cluster mean, with the rank.

    Ranks are for members of one cluster, a short listing; rank ties follow the id.
    All columns of ``df`` are sorted along: give only those the listing shows.
    """
    rows = labelled_members(df, label).filter(
        x.is_finite("plx_sp") & x.is_finite("err_sp") & (F.col("err_sp") > 0))
    mean, _ = inverse_variance("plx_sp", "err_sp")
    # Written once: its true size tells whether the members need a shuffle to meet it.
    means = stage(rows.groupBy(label).agg(mean.alias("__m")))
    scored = on_groups(rows, means, [label])
    scored = scored.withColumn("chi", (F.col("plx_sp") - F.col("__m")) / F.col("err_sp")).drop("__m")
    return ordinal_rank(scored, [label], [F.desc(F.abs("chi")), F.col(row_id)], "chi_rank")


def prepare_member_spectra(members: DataFrame, spectra: DataFrame, *, key: str = "sdss_id",
                           gaia_id: str = "gaia_dr3_source_id", probs: DataFrame | None = None,
                           prob_min: float = 0.9, require_clean: bool = True, snr_min: float = 0.0,
                           row_id: Sequence[str] = ()) -> DataFrame:
    """One clean spectrum per member and cluster, carrying the membership probability.

    Scalars are cut and deduplicated before the wide array columns are touched.
    """
    if probs is not None:
        members = membership_probability(members, probs, "cluster", gaia_id, "prob", prob_min)
    # A star listed under several catalogue ids keeps its highest probability.
    carry = [F.max("memberprob").alias("memberprob")] if probs is not None else []
    members = members.groupBy("cluster", key).agg(*carry) if carry else members.select("cluster", key).distinct()
    order = [c for c in ("snr", "spectrum_flags") if c in spectra.columns]
    rows = selection.clean_spectra(spectra, require_clean, snr_min)
    narrow = rows.select(*dict.fromkeys([key, *row_id, *order])).join(
        members.select(key).distinct(), key, "left_semi")
    best = keep_highest(narrow, [key], "snr", list(row_id)).select(key, *row_id)
    return rows.join(best, [key, *row_id], "left_semi").join(members, key)


def matched_fraction(members: DataFrame, found: DataFrame, key: str = "sdss_id") -> DataFrame:
    """Per cluster matched and total members with a TOTAL row."""
    ids = members.select("cluster", key).distinct()
    hit = found.select("cluster", key).distinct().withColumn("__hit", F.lit(1))
    joined = ids.join(hit, ["cluster", key], "left")
    return (joined.rollup("cluster").agg(
                F.count("__hit").alias("n_found"), F.count(F.lit(1)).alias("n_members"),
                F.grouping("cluster").alias("__g"))
            .select(F.when(F.col("__g") == 1, "TOTAL").otherwise(F.col("cluster").cast("string")).alias("cluster"),
                    "n_found", "n_members", (100.0 * F.col("n_found") / F.col("n_members")).alias("pct")))


def selection_counts(cone: DataFrame, moving: DataFrame) -> DataFrame:
    """Members left per cluster after the cone and after the proper-motion cut."""
    c = cone.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cone"))
    m = moving.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_comoving"))
    return c.join(m, "cluster", "left").na.fill({"n_comoving": 0})
