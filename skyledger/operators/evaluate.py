"""Scoring of a result catalog, always in parallax space.

Every function takes a catalog with ``plx, e_plx, plx_sp, err_sp`` (and
``sample`` for folds).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions import exprs as x
from skyledger.operators.quantiles import (exact_quantiles, medians,
                                           on_groups, with_scalars)
from skyledger.operators.ranking import spearman
from skyledger.operators.robust import (MAD_SCALE, fraction, quantile_bins, robust_stats,
                                        unique_edge_bins)

MIN_BIN_ROWS = 20
NOTEBOOK_MIN_BIN_ROWS = 50


def clean_catalog(cat: DataFrame) -> DataFrame:
    """Catalog with non-finite parallax columns as null."""
    return cat.withColumns({c: x.finite(c) for c in ("plx", "e_plx", "plx_sp", "err_sp")
                            if c in cat.columns})


# What each figure of the report is taken from.
_FIGURES = {"median_frac_resid": ["frac"], "robust_frac_scatter": ["frac"], "median_spec_err_frac": ["err_frac"],
            "chi2_mean_chi2": ["chi2"], "chi2_median_chi2": ["chi2"], "chi2_robust_chi2": ["chi"], "chi2_n": ["chi"]}


def evaluate(cat: DataFrame, snr: float = 20.0, offset: float = 0.0,
             by: Sequence[str] = (), folds: bool = True, sample: str = "sample", figures: Sequence[str] | None = None) -> DataFrame:
    """Headline report per fold: bias, robust scatter, quoted error, chi-square.

    By fold, A and B rows count under their own fold and every row under ``all``,
    whose counts and sums are those of the folds added up. ``figures`` names those
    wanted besides the counts (all); the passes then count only the values they need.
    """
    by, figures = list(by), list(_FIGURES if figures is None else figures)
    needed = {v for f in figures for v in _FIGURES[f]}
    cat = clean_catalog(cat)
    if folds:
        by = [*by, "fold"]
        cat = cat.withColumn("fold", F.when(F.col(sample).isin("A", "B"), F.col(sample)))
    probe = x.hi_snr("plx", "e_plx", snr)
    chi = x.z_score("plx_sp", "plx", "e_plx", "err_sp", offset)
    rows = cat.select(
        *by, probe.alias("probe"),
        F.when(probe, x.fractional_residual("plx_sp", "plx", offset)).alias("frac"),
        x.ratio("err_sp", "plx_sp").alias("err_frac"), chi.alias("chi"), (chi * chi).alias("chi2"))
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), F.count_if("probe").alias("n_hi_snr_probe"),
                                 F.sum(x.finite("chi2")).alias("chi2_sum"))
    if folds:
        own = F.when(F.col("fold").isNotNull(), F.array(F.lit("all"), F.col("fold")))
        sums = sums.withColumn("fold", F.explode(F.coalesce(own, F.array(F.lit("all"))))).groupBy(*by).agg(
            *[F.sum(c).alias(c) for c in ("n_total", "n_hi_snr_probe", "chi2_sum")])
    if not needed:
        return sums.select(*by, "n_total", "n_hi_snr_probe")
    spread = robust_stats(rows, by, [v for v in ("frac", "err_frac", "chi", "chi2") if v in needed], total=("fold", "all") if folds else None)
    out = on_groups(spread, sums, by)
    found = {"median_frac_resid": F.col("frac_med"), "robust_frac_scatter": F.col("frac_scatter"), "median_spec_err_frac": F.col("err_frac_med"),
             "chi2_mean_chi2": F.try_divide("chi2_sum", "chi2_n"), "chi2_median_chi2": F.col("chi2_med"),
             "chi2_robust_chi2": F.col("chi_scatter") * F.col("chi_scatter"), "chi2_n": F.col("chi_n")}
    return out.select(*by, "n_total", "n_hi_snr_probe", *[found[f].alias(f) for f in figures])


def chi2_stats(cat: DataFrame, by: Sequence[str], offset: float = 0.0) -> DataFrame:
    """n, mean, median and robust chi-square per group."""
    cat = clean_catalog(cat)
    chi = x.z_score("plx_sp", "plx", "e_plx", "err_sp", offset)
    rows = cat.select(*by, chi.alias("chi"), (chi * chi).alias("chi2"))
    out = robust_stats(rows, by, ["chi", "chi2"], extra=[F.avg("chi2").alias("mean_chi2")])
    return out.select(*by, F.col("chi_n").alias("n"), "mean_chi2",
                      F.col("chi2_med").alias("median_chi2"),
                      (F.col("chi_scatter") * F.col("chi_scatter")).alias("robust_chi2"))


def z_report(cat: DataFrame, by: Sequence[str], offset: float = 0.0) -> DataFrame:
    """Robust width and centre of z and the share beyond three sigma."""
    rows = clean_catalog(cat).select(
        *by, x.z_score("plx_sp", "plx", "e_plx", "err_sp", offset).alias("z"))
    rows = rows.filter(F.col("z").isNotNull())
    out = robust_stats(rows, by, ["z"], extra=[fraction(F.abs("z") > 3).alias("tail_gt3")])
    return out.select(*by, F.col("z_n").alias("n"), F.col("z_med").alias("z_median"),
                      F.col("z_scatter").alias("z_width"), "tail_gt3")


def coverage(cat: DataFrame, by: Sequence[str], offset: float = 0.0,
             levels: Sequence[float] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Share of rows within k sigma next to the Gaussian share, one row per k."""
    z = x.z_score("plx_sp", "plx", "e_plx", "err_sp", offset)
    rows = clean_catalog(cat).select(*by, F.abs(z).alias("z")).filter(F.col("z").isNotNull())
    shares = rows.groupBy(*by).agg(*[
        fraction(F.col("z") <= k).alias(f"k{i}") for i, k in enumerate(levels)])
    table = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.col(f"k{i}").alias("emp"),
                               F.lit(math.erf(k / math.sqrt(2.0))).alias("nominal"))
                      for i, k in enumerate(levels)])
    return shares.select(*by, F.explode(table).alias("row")).select(*by, "row.*")


def _calibration_rows(cat: DataFrame, by: Sequence[str], axis: Column | None, offset: float,
                      snr: float) -> DataFrame:
    err_frac = x.ratio("err_sp", "plx_sp")
    axis = err_frac if axis is None else x.finite(axis)
    resid = F.col("plx_sp") - (F.col("plx") + F.lit(float(offset)))
    keep = (x.hi_snr("plx", "e_plx", snr) & x.holds(F.col("plx_sp") > 0)
            & x.holds(F.col("err_sp") > 0) & F.col("e_plx").isNotNull())
    return clean_catalog(cat).filter(keep).select(
        *by, axis.alias("axis"), "plx_sp", (F.col("e_plx") * F.col("e_plx")).alias("var_a"),
        err_frac.alias("err_frac"), resid.alias("resid"),
        x.z_score("plx_sp", "plx", "e_plx", "err_sp", offset).alias("chi"))


def calibration_bins(cat: DataFrame, by: Sequence[str] = (), axis: Column | None = None,
                     offset: float = 0.0, nbins: int = 8, snr: float = 20.0,
                     min_rows: int = MIN_BIN_ROWS) -> DataFrame:
    """Quoted against observed error on the probe, in quantile bins of ``axis``.

    The axis defaults to the quoted fractional error. The observed error is the
    robust residual scatter with the median catalog variance taken out, floored
    at zero.
    """
    rows = _calibration_rows(cat, by, axis, offset, snr)
    binned = quantile_bins(rows, by, "axis", nbins)
    keys = [*by, "bin"]
    out = robust_stats(binned, keys, ["resid", "var_a", "plx_sp", "err_frac", "chi", "axis"]).withColumnRenamed("axis_n", "n")  # every binned row has an axis value
    var = F.col("resid_scatter") * F.col("resid_scatter") - F.col("var_a_med")
    obs = F.when(F.col("plx_sp_med") > 0,
                 F.sqrt(F.greatest(var, F.lit(0.0))) / F.col("plx_sp_med"))
    return (out.filter(F.col("n") >= min_rows)
            .select(*keys, "n", F.col("axis_med"), F.col("err_frac_med").alias("pred_frac"),
                    obs.alias("obs_frac"), F.col("chi_scatter").alias("robust_chi"))
            .withColumn("ratio", F.when(F.col("pred_frac") > 0,
                                        x.ratio("obs_frac", "pred_frac"))))


def bias_bins(cat: DataFrame, by: Sequence[str] = (), axis: Column | None = None,
              offset: float = 0.0, nbins: int = 8, snr: float = 20.0,
              min_rows: int = MIN_BIN_ROWS) -> DataFrame:
    """Median and robust scatter of the fractional residual in quantile bins."""
    axis = x.ratio("err_sp", "plx_sp") if axis is None else x.finite(axis)
    rows = (clean_catalog(cat)
            .filter(x.hi_snr("plx", "e_plx", snr) & (F.col("plx") != 0) & F.col("plx_sp").isNotNull())
            .select(*by, axis.alias("axis"),
                    x.fractional_residual("plx_sp", "plx", offset).alias("frac")))
    binned = quantile_bins(rows, by, "axis", nbins)
    out = robust_stats(binned, [*by, "bin"], ["axis", "frac"]).withColumnRenamed("axis_n", "n")
    return out.filter(F.col("n") >= min_rows).select(
        *by, "bin", "n", "axis_med", F.col("frac_med").alias("bias"),
        F.col("frac_scatter").alias("scatter"))


def bias_by_column(cat: DataFrame, column: str, by: Sequence[str] = (), nbins: int = 8) -> DataFrame:
    """Bias against any attached column on held-out rows, with unique quantile edges.

    The largest value falls outside the half-open bins, as in the digitised form.
    """
    rows = (clean_catalog(cat).filter(F.col("sample").isin("A", "B"))
            .select(*by, x.finite(column).alias("axis"), "plx", "plx_sp")
            .filter(F.col("axis").isNotNull() & F.col("plx").isNotNull()
                    & F.col("plx_sp").isNotNull()))
    binned = unique_edge_bins(rows, by, "axis", nbins).filter(F.col("plx") != 0)
    binned = binned.withColumn("frac", x.fractional_residual("plx_sp", "plx"))
    keys = [*by, "bin"]
    counts = binned.groupBy(*keys).agg(F.count("frac").alias("n"))
    med = medians(binned, keys, ["axis", "frac"])
    return on_groups(counts, med, keys).select(
        *keys, "n", F.col("axis").alias("axis_med"), F.col("frac").alias("bias"))


def reliability_curve(cat: DataFrame, by: Sequence[str] = (), nbins: int = 10,
                      min_rows: int = NOTEBOOK_MIN_BIN_ROWS) -> DataFrame:
    """Median quoted error against realised scatter in quantile bins of the error."""
    rows = (clean_catalog(cat)
            .select(*by, "err_sp", (F.col("plx_sp") - F.col("plx")).alias("resid"))
            .filter(F.col("err_sp").isNotNull() & F.col("resid").isNotNull()))
    out = robust_stats(quantile_bins(rows, by, "err_sp", nbins), [*by, "bin"],
                       ["err_sp", "resid"]
                       ).withColumnRenamed("err_sp_n", "n")
    return out.filter(F.col("n") >= min_rows).select(
        *by, "bin", "n", F.col("err_sp_med").alias("predicted"),
        F.col("resid_scatter").alias("realised"))


def sharpness(cat: DataFrame, by: Sequence[str], tie_break: Sequence[str], offset: float = 0.0,
              snr: float = 20.0) -> DataFrame:
    """Rank correlation of the quoted error with the absolute residual on the probe."""
    resid = F.abs(F.col("plx_sp") - (F.col("plx") + F.lit(float(offset))))
    rows = (clean_catalog(cat).filter(x.hi_snr("plx", "e_plx", snr) & (F.col("err_sp") > 0))
            .select(*by, *tie_break, "err_sp", resid.alias("resid"))
            .filter(F.col("resid").isNotNull()))
    return spearman(rows, by, "err_sp", "resid", tie_break)


def overfit_gap(in_fold: DataFrame, held_out: DataFrame, snr: float = 20.0) -> DataFrame:
    """Robust scatter of in-fold and held-out predictions and the gap in points."""
    a = evaluate(in_fold, snr, figures=["robust_frac_scatter"]).select("fold", F.col("robust_frac_scatter").alias("in_fold"))
    b = evaluate(held_out, snr, figures=["robust_frac_scatter"]).select("fold", F.col("robust_frac_scatter").alias("held_out"))
    return a.join(b, "fold").withColumn("gap_pp", 100.0 * (F.col("held_out") - F.col("in_fold")))


def distance_check(cat: DataFrame, by: Sequence[str], reference_pc: str) -> DataFrame:
    """Spectral distance against an independent estimate (given in parsec)."""
    ref = x.pc_to_kpc(x.finite(reference_pc))
    rows = (clean_catalog(cat).select(*by, x.distance_kpc("plx_sp").alias("d"), ref.alias("r"))
            .filter((F.col("d") > 0) & (F.col("r") > 0))
            .select(*by, ((F.col("d") - F.col("r")) / F.col("r")).alias("frac")))
    out = robust_stats(rows, by, ["frac"])
    return out.select(*by, F.col("frac_n").alias("n"), F.col("frac_med").alias("median_offset"),
                      F.col("frac_scatter").alias("robust_scatter"))


def precision_ratio(cat: DataFrame, by: Sequence[str], max_kpc: float = 20.0) -> DataFrame:
    """Mean log error ratio and the share of rows where the spectral error is smaller."""
    r = x.log_precision_ratio("e_plx", "err_sp")
    rows = (clean_catalog(cat).select(*by, r.alias("ratio"), x.distance_kpc("plx_sp").alias("d"))
            .filter(F.col("ratio").isNotNull() & (F.col("d") > 0) & (F.col("d") < max_kpc)))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("mean_log_ratio"),
                                 fraction(F.col("ratio") > 0).alias("share_more_precise"))


def catalog_overview(cat: DataFrame) -> DataFrame:
    """One row: counts, shares and distance quantiles of a catalog."""
    cat = clean_catalog(cat).withColumns({
        "d": x.distance_kpc("plx_sp"), "zp": x.finite("zeropoint"),
        "probe": x.hi_snr("plx", "e_plx") & x.holds(F.col("plx") > 0)})
    counts = cat.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("train").alias("n_train"),
        fraction(F.col("train")).alias("train_share"),
        F.count_if(F.col("sample") == "A").alias("n_a"), F.count_if(F.col("sample") == "B").alias("n_b"),
        fraction(F.col("plx") < 0).alias("negative_share"), F.count_if("probe").alias("n_probe"),
        fraction(F.col("probe")).alias("probe_share"),
        *[F.count_if(x.holds(F.col("d") > k)).alias(f"n_beyond_{k}kpc") for k in (8, 10, 15)])
    q = exact_quantiles(cat, [], ["d", "zp"], [0.25, 0.5, 0.75]).select(
        F.col("d")[1].alias("d_median"), F.col("d")[0].alias("d_q25"), F.col("d")[2].alias("d_q75"),
        F.col("zp")[1].alias("zp_median"))
    return with_scalars(counts, q)


def ln_ratio_comparison(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Row-by-row comparison of two prediction sets: median and scatter of ln(a/b)."""
    joined = a.select(key, F.col("plx_sp").alias("a")).join(
        b.select(key, F.col("plx_sp").alias("b")), key)
    rows = joined.select(F.ln(x.ratio("a", "b")).alias("lnr"))
    out = robust_stats(rows, [], ["lnr"], extra=[F.count(F.lit(1)).alias("n_matched")])
    return out.select("n_matched", F.col("lnr_med").alias("median_ln_ratio"),
                      F.col("lnr_scatter").alias("robust_scatter"))


def split_scatter(cat: DataFrame, columns: Sequence[str], offset: float = 0.0,
                  snr: float = 20.0) -> DataFrame:
    """Residual scatter at or below and above the median of housekeeping columns."""
    rows = clean_catalog(cat).filter(x.hi_snr("plx", "e_plx", snr)).select(
        x.fractional_residual("plx_sp", "plx", offset).alias("frac"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                     x.finite(F.col(c).cast("double")).alias("x")) for c in columns])).alias("p")
    ).select("frac", "p.column", "p.x")
    med = medians(rows, ["column"], ["x"]).withColumnRenamed("x", "x_med")
    sided = on_groups(rows, med, ["column"]).withColumn(
        "side", F.when(F.col("x") <= F.col("x_med"), "below").when(F.col("x") > F.col("x_med"), "above"))
    out = robust_stats(sided.filter(F.col("side").isNotNull()), ["column", "side"], ["frac"])
    return out.select("column", "side", F.col("frac_n").alias("n"),
                      F.col("frac_scatter").alias("scatter"))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def qq_table(cat: DataFrame, by: Sequence[str], probs: Sequence[float], offset: float = 0.0,
             clip: float = 12.0) -> DataFrame:
    """Empirical quantiles of the clipped z next to those of a unit Gaussian."""
    z = x.z_score("plx_sp", "plx", "e_plx", "err_sp", offset)
    rows = clean_catalog(cat).select(*by, x.clip(z, -clip, clip).alias("z"), z.alias("raw"))
    rows = rows.filter(F.col("raw").isNotNull()).drop("raw")
    q = exact_quantiles(rows, by, ["z"], probs)
    table = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(normal_quantile(p)).alias("normal"),
                               F.col("z")[i].alias("empirical")) for i, p in enumerate(probs)])
    return q.select(*by, F.explode(table).alias("row")).select(*by, "row.*")


def saturation(cat: DataFrame, by: Sequence[str], std_factor: float = 1.0,
               tol: float = 0.01) -> DataFrame:
    """Shares of predicted sigmas pinned at either clamp."""
    sigma = x.finite(F.col("err_sp") / F.lit(float(std_factor)))
    lo, hi = math.exp(x.LOG_SIGMA_MIN), math.exp(x.LOG_SIGMA_MAX)
    rows = cat.select(*by, sigma.alias("s")).filter(F.col("s").isNotNull())
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                 fraction(F.col("s") <= lo * (1 + tol)).alias("at_floor"),
                                 fraction(F.col("s") >= hi * (1 - tol)).alias("at_ceiling"))


def honesty_budget(cat: DataFrame) -> DataFrame:
    """Gate and hull summary of the training rows of a gated model's catalog."""
    rows = cat.filter(F.col("train")).select(x.finite("gate").alias("gate"),
                                             x.finite("hull_d").alias("hull_d"))
    q = exact_quantiles(rows, [], ["gate", "hull_d"], [0.5, 0.99]).select(
        F.col("gate")[0].alias("gate_median"), F.col("hull_d")[0].alias("hull_median"),
        F.col("hull_d")[1].alias("hull_p99"))
    shares = rows.agg(F.count(F.lit(1)).alias("n_train"),
                      fraction(F.col("gate") < 0.5).alias("gate_lt_half"))
    return with_scalars(shares, q)


def value_digest(df: DataFrame, key: str, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Order-free digest of rounded values.

    Each row hashes to 60 bits; the hashes add up modulo 2 to the 63, so the digest
    depends neither on order nor on partitioning and equal rows do not cancel.
    """
    text = F.concat_ws("|", F.col(key).cast("string"), *[
        F.coalesce(F.round(F.col(c).cast("double") * 10 ** digits).cast("long").cast("string"),
                   F.lit("null")) for c in columns])
    word = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    total = F.sum(F.col("w").cast("decimal(20,0)")) % F.lit("9223372036854775808").cast("decimal(20,0)")
    return df.select(word.alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), total.cast("long").alias("digest"))


def sweep_summary(cat: DataFrame, by: Sequence[str], offset: float = 0.0) -> DataFrame:
    """One row per configuration: z width, tail share and one-sigma coverage."""
    z = x.z_score("plx_sp", "plx", "e_plx", "err_sp", offset)
    rows = clean_catalog(cat).select(*by, z.alias("z")).filter(F.col("z").isNotNull())
    out = robust_stats(rows, by, ["z"], extra=[fraction(F.abs("z") > 3).alias("tail_gt3"),
                                               fraction(F.abs("z") <= 1).alias("cov_1sigma")])
    return out.select(*by, F.col("z_n").alias("n"), F.col("z_scatter").alias("z_width"),
                      "tail_gt3", "cov_1sigma")
