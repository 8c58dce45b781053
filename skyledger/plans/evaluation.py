"""Queries over the result catalog: scoring, calibration bins, distribution checks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skyledger.functions import exprs as x
from skyledger.operators import evaluate as ev
from skyledger.plans.registry import query
from skyledger.plans.tables import CLEAN, HUB, fold_rows, hub, messy, r, round_all, table

# SQL pieces shared by the oracles of this module.
PROBE = "coalesce(plx / nullif(e_plx, 0) >= 20, false)"
FRAC = "(plx_sp - plx) / nullif(plx, 0)"
CHI = "(plx_sp - plx) / nullif(sqrt(e_plx * e_plx + err_sp * err_sp), 0)"


def _evaluate_sql(prelude: str, source: str, by: str = "fold") -> str:
    return f"""WITH {prelude}, {fold_rows(source)}, m AS (
      SELECT fold, {PROBE} AS probe, CASE WHEN {PROBE} THEN {FRAC} END AS frac,
        err_sp / nullif(plx_sp, 0) AS ef, {CHI} AS chi FROM folds)
      SELECT fold, count(*) AS n_total, count(*) FILTER (probe) AS n_hi_snr_probe,
        {r('median(frac)')} AS median_frac_resid, {r('1.48::DOUBLE * mad(frac)')} AS robust_frac_scatter,
        {r('median(ef)')} AS median_spec_err_frac, {r('avg(chi * chi)')} AS chi2_mean_chi2,
        {r('median(chi * chi)')} AS chi2_median_chi2,
        {r('(1.48::DOUBLE * mad(chi)) ** 2')} AS chi2_robust_chi2, count(chi) AS chi2_n
      FROM m GROUP BY fold"""


@query("evaluate_by_fold", _evaluate_sql(HUB, "hub"))
def evaluate_by_fold(spark, sf):
    return round_all(ev.evaluate(hub(spark, sf)))


@query("evaluate_missing_values", _evaluate_sql(CLEAN, "cat"))
def evaluate_missing_values(spark, sf):
    return round_all(ev.evaluate(messy(spark, sf)))


@query("evaluate_with_offset", f"""WITH {CLEAN}, m AS (
  SELECT cluster, CASE WHEN {PROBE} THEN (plx_sp - (plx + 0.048)) / nullif(plx, 0) END AS frac FROM cat)
  SELECT cluster, count(frac) AS n, {r('median(frac)')} AS bias, {r('1.48::DOUBLE * mad(frac)')} AS scatter
  FROM m GROUP BY cluster""")
def evaluate_with_offset(spark, sf):
    out = ev.evaluate(messy(spark, sf), offset=0.048, by=["cluster"], folds=False, figures=["median_frac_resid", "robust_frac_scatter"])
    return round_all(out.select("cluster", F.col("n_hi_snr_probe").alias("n"),
                                F.col("median_frac_resid").alias("bias"),
                                F.col("robust_frac_scatter").alias("scatter")))


@query("chi2_stats", f"""WITH {CLEAN}, m AS (SELECT sample, {CHI} AS chi FROM cat)
  SELECT sample, count(chi) AS n, {r('avg(chi * chi)')} AS mean_chi2, {r('median(chi * chi)')} AS median_chi2,
    {r('(1.48::DOUBLE * mad(chi)) ** 2')} AS robust_chi2 FROM m GROUP BY sample""")
def chi2_stats(spark, sf):
    return round_all(ev.chi2_stats(messy(spark, sf), ["sample"]))


@query("fractional_residual", f"""WITH {CLEAN}
  SELECT sdss_id, {r('(plx_sp - (plx + 0.03)) / nullif(plx, 0)')} AS resid FROM cat""")
def fractional_residual(spark, sf):
    return round_all(ev.clean_catalog(messy(spark, sf)).select(
        "sdss_id", x.fractional_residual("plx_sp", "plx", 0.03).alias("resid")))


@query("z_report", f"""WITH {CLEAN}, m AS (SELECT sample, {CHI} AS z FROM cat)
  SELECT sample, count(z) AS n, {r('median(z)')} AS z_median, {r('1.48::DOUBLE * mad(z)')} AS z_width,
    {r('avg((abs(z) > 3)::INT::DOUBLE)')} AS tail_gt3 FROM m WHERE z IS NOT NULL GROUP BY sample""")
def z_report(spark, sf):
    return round_all(ev.z_report(messy(spark, sf), ["sample"]))


@query("coverage", f"""WITH {CLEAN}, m AS (SELECT sample, abs({CHI}) AS z FROM cat),
  lv(k, nominal) AS (VALUES {", ".join(f"({float(k)}::DOUBLE, {math.erf(k / math.sqrt(2))!r}::DOUBLE)" for k in (1, 2, 3))})
  SELECT sample, k, {r('avg((z <= k)::INT::DOUBLE)')} AS emp, {r('any_value(nominal)')} AS nominal
  FROM m, lv WHERE z IS NOT NULL GROUP BY sample, k""")
def coverage(spark, sf):
    return round_all(ev.coverage(messy(spark, sf), ["sample"]))


def _bins_sql(by: str, axis: str, nbins: int, where: str, inner: str, outer: str, having: str,
              prelude: str = CLEAN, source: str = "cat") -> str:
    """Quantile-bin oracle: edges per group, open top bin, then statistics per bin."""
    probs = ", ".join(repr(i / nbins) for i in range(nbins + 1))
    number = " + ".join(f"(axis >= e[{i + 1}])::INT" for i in range(nbins))
    return f"""WITH {prelude}, rows0 AS (SELECT {by}, {axis} AS axis, {inner} FROM {source} WHERE {where}),
      keep AS (SELECT * FROM rows0 WHERE axis IS NOT NULL),
      edges AS (SELECT {by}, quantile_cont(axis, [{probs}]) AS e FROM keep GROUP BY {by}),
      b AS (SELECT keep.*, ({number}) - 1 AS bin FROM keep JOIN edges USING ({by}))
      SELECT {by}, bin, {outer} FROM b GROUP BY {by}, bin HAVING {having}"""


CAL_WHERE = f"{PROBE} AND plx_sp > 0 AND err_sp > 0 AND e_plx IS NOT NULL"
CAL_INNER = f"plx_sp - plx AS resid, e_plx * e_plx AS va, plx_sp, err_sp / nullif(plx_sp, 0) AS ef, {CHI} AS chi"
_OBS = ("CASE WHEN median(plx_sp) > 0 THEN sqrt(greatest((1.48::DOUBLE * mad(resid)) ** 2 - median(va), 0)) "
        "/ median(plx_sp) END")
CAL_OUTER = f"""count(*) AS n, {r('median(axis)')} AS axis_med, {r('median(ef)')} AS pred_frac,
  {r(_OBS)} AS obs_frac, {r('1.48::DOUBLE * mad(chi)')} AS robust_chi,
  {r(f'{_OBS} / nullif(median(ef), 0)')} AS ratio"""


@query("calibration_bins", _bins_sql("sample", "err_sp / nullif(plx_sp, 0)", 8, CAL_WHERE, CAL_INNER,
                                     CAL_OUTER, "count(*) >= 20"))
def calibration_bins(spark, sf):
    return round_all(ev.calibration_bins(messy(spark, sf), by=["sample"]))


@query("calibration_by_distance", _bins_sql(
    "sample", "CASE WHEN isfinite(r_med_photogeo_pc) THEN r_med_photogeo_pc / 1000 END", 8,
    CAL_WHERE + " AND sample IN ('A', 'B')", CAL_INNER, CAL_OUTER, "count(*) >= 50"))
def calibration_by_distance(spark, sf):
    cat = messy(spark, sf).filter(F.col("sample").isin("A", "B"))
    return round_all(ev.calibration_bins(cat, by=["sample"], axis=F.col("r_med_photogeo_pc") / 1000,
                                         min_rows=ev.NOTEBOOK_MIN_BIN_ROWS))


_MAG = HUB + """, withmag AS (SELECT hub.*, p_retailprice / 100 AS g_mag FROM hub
  LEFT JOIN part ON l_partkey = p_partkey), cat AS (SELECT * FROM withmag)"""


@query("calibration_by_magnitude", _bins_sql("sample", "g_mag", 8, CAL_WHERE, CAL_INNER, CAL_OUTER,
                                             "count(*) >= 50", prelude=_MAG))
def calibration_by_magnitude(spark, sf):
    mags = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("g_mag"))
    cat = hub(spark, sf).join(mags, F.col("l_partkey") == F.col("p_partkey"), "left")
    return round_all(ev.calibration_bins(cat, by=["sample"], axis=F.col("g_mag"),
                                         min_rows=ev.NOTEBOOK_MIN_BIN_ROWS))


BIAS_WHERE = f"{PROBE} AND plx <> 0 AND plx_sp IS NOT NULL"
BIAS_OUTER = f"""count(*) AS n, {r('median(axis)')} AS axis_med, {r('median(frac)')} AS bias,
  {r('1.48::DOUBLE * mad(frac)')} AS scatter"""


@query("bias_bins", _bins_sql("sample", "err_sp / nullif(plx_sp, 0)", 8, BIAS_WHERE, f"{FRAC} AS frac",
                              BIAS_OUTER, "count(*) >= 20"))
def bias_bins(spark, sf):
    return round_all(ev.bias_bins(messy(spark, sf), by=["sample"]))


@query("bias_bins_by_prediction", _bins_sql("sample", "plx_sp", 8, BIAS_WHERE, f"{FRAC} AS frac",
                                            BIAS_OUTER, "count(*) >= 50"))
def bias_bins_by_prediction(spark, sf):
    return round_all(ev.bias_bins(messy(spark, sf), by=["sample"], axis=F.col("plx_sp"),
                                  min_rows=ev.NOTEBOOK_MIN_BIN_ROWS))


@query("bias_by_column", f"""WITH {CLEAN}, rows0 AS (
    SELECT sample, l_quantity AS axis, plx, plx_sp FROM cat
    WHERE sample IN ('A', 'B') AND plx IS NOT NULL AND plx_sp IS NOT NULL),
  edges AS (SELECT sample, list_sort(list_distinct(quantile_cont(axis, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))) AS e
    FROM rows0 GROUP BY sample),
  b AS (SELECT rows0.*, len(list_filter(e, lambda v: v <= axis)) AS bin, len(e) AS ne FROM rows0 JOIN edges USING (sample))
  SELECT sample, bin, count(*) AS n, {r('median(axis)')} AS axis_med, {r(f'median({FRAC})')} AS bias
  FROM b WHERE bin < ne AND plx <> 0 GROUP BY sample, bin""")
def bias_by_column(spark, sf):
    return round_all(ev.bias_by_column(messy(spark, sf), "l_quantity", ["sample"]))


@query("reliability_curve", _bins_sql("sample", "err_sp", 10, "err_sp IS NOT NULL AND plx_sp - plx IS NOT NULL",
                                      "plx_sp - plx AS resid",
                                      f"""count(*) AS n, {r('median(axis)')} AS predicted,
                                      {r('1.48::DOUBLE * mad(resid)')} AS realised""", "count(*) >= 50"))
def reliability_curve(spark, sf):
    return round_all(ev.reliability_curve(messy(spark, sf), ["sample"]))


@query("sharpness", f"""WITH {CLEAN}, m AS (SELECT sample, sdss_id, err_sp, abs(plx_sp - plx) AS resid FROM cat
    WHERE {PROBE} AND err_sp > 0 AND plx_sp - plx IS NOT NULL),
  k AS (SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY err_sp, sdss_id) AS rx,
    row_number() OVER (PARTITION BY sample ORDER BY resid, sdss_id) AS ry FROM m)
  SELECT sample, count(*) AS n, {r('corr(rx, ry)')} AS rho FROM k GROUP BY sample""")
def sharpness(spark, sf):
    return round_all(ev.sharpness(messy(spark, sf), ["sample"], ["sdss_id"]))


@query("overfit_gap", f"""WITH {HUB}, {fold_rows('hub')}, m AS (
    SELECT fold, {PROBE} AS p, {FRAC} AS h, (plx + 0.8::DOUBLE * (plx_sp - plx) - plx) / plx AS i FROM folds),
  s AS (SELECT fold, 1.48::DOUBLE * mad(i) AS a, 1.48::DOUBLE * mad(h) AS b FROM m WHERE p GROUP BY fold)
  SELECT fold, {r('a')} AS in_fold, {r('b')} AS held_out, {r('100 * (b - a)')} AS gap_pp FROM s""")
def overfit_gap(spark, sf):
    cat = hub(spark, sf)
    tighter = cat.withColumn("plx_sp", F.col("plx") + 0.8 * (F.col("plx_sp") - F.col("plx")))
    return round_all(ev.overfit_gap(tighter, cat))


@query("distance_check", f"""WITH {CLEAN}, m AS (SELECT sample, 1 / nullif(plx_sp, 0) AS d,
    CASE WHEN isfinite(r_med_photogeo_pc) THEN r_med_photogeo_pc / 1000 END AS rr FROM cat),
  f AS (SELECT sample, (d - rr) / rr AS frac FROM m WHERE d > 0 AND rr > 0)
  SELECT sample, count(*) AS n, {r('median(frac)')} AS median_offset, {r('1.48::DOUBLE * mad(frac)')} AS robust_scatter
  FROM f GROUP BY sample""")
def distance_check(spark, sf):
    return round_all(ev.distance_check(messy(spark, sf), ["sample"], "r_med_photogeo_pc"))


@query("precision_ratio", f"""WITH {CLEAN}, m AS (SELECT sample, log10(nullif(e_plx / nullif(err_sp, 0), 0)) AS q,
    1 / nullif(plx_sp, 0) AS d FROM cat)
  SELECT sample, count(*) AS n, {r('avg(q)')} AS mean_log_ratio, {r('avg((q > 0)::INT::DOUBLE)')} AS share_more_precise
  FROM m WHERE q IS NOT NULL AND d > 0 AND d < 20 GROUP BY sample""")
def precision_ratio(spark, sf):
    return round_all(ev.precision_ratio(messy(spark, sf), ["sample"]))


@query("catalog_overview", f"""WITH {CLEAN}, m AS (SELECT *, 1 / nullif(plx_sp, 0) AS d,
    CASE WHEN isfinite(zeropoint) THEN zeropoint END AS zp, {PROBE} AND plx > 0 AS probe FROM cat)
  SELECT count(*) AS n, count(*) FILTER (train) AS n_train, {r('avg(train::INT::DOUBLE)')} AS train_share,
    count(*) FILTER (sample = 'A') AS n_a, count(*) FILTER (sample = 'B') AS n_b,
    {r('avg(coalesce(plx < 0, false)::INT::DOUBLE)')} AS negative_share, count(*) FILTER (probe) AS n_probe,
    {r('avg(coalesce(probe, false)::INT::DOUBLE)')} AS probe_share,
    count(*) FILTER (d > 8) AS n_beyond_8kpc, count(*) FILTER (d > 10) AS n_beyond_10kpc,
    count(*) FILTER (d > 15) AS n_beyond_15kpc, {r('median(d)')} AS d_median,
    {r('quantile_cont(d, 0.25)')} AS d_q25, {r('quantile_cont(d, 0.75)')} AS d_q75, {r('median(zp)')} AS zp_median
  FROM m""")
def catalog_overview(spark, sf):
    return round_all(ev.catalog_overview(messy(spark, sf)))


@query("ln_ratio_comparison", f"""WITH {HUB}, other AS (SELECT sdss_id, plx_sp * (1 + (l_quantity - 25) / 500) AS b FROM hub WHERE l_orderkey % 3 <> 0),
  m AS (SELECT ln(plx_sp / b) AS lnr FROM hub JOIN other USING (sdss_id))
  SELECT count(*) AS n_matched, {r('median(lnr)')} AS median_ln_ratio, {r('1.48::DOUBLE * mad(lnr)')} AS robust_scatter FROM m""")
def ln_ratio_comparison(spark, sf):
    cat = hub(spark, sf)
    other = cat.filter(F.col("l_orderkey") % 3 != 0).withColumn(
        "plx_sp", F.col("plx_sp") * (1 + (F.col("l_quantity") - 25) / 500))
    return round_all(ev.ln_ratio_comparison(cat, other, "sdss_id"))


@query("split_scatter", f"""WITH {CLEAN}, p AS (SELECT {FRAC} AS frac, l_quantity, snr FROM cat WHERE {PROBE}),
  l AS (SELECT frac, 'l_quantity' AS "column", l_quantity AS x FROM p UNION ALL SELECT frac, 'snr', snr FROM p),
  md AS (SELECT "column", median(x) AS xm FROM l GROUP BY 1),
  s AS (SELECT l.*, CASE WHEN x <= xm THEN 'below' ELSE 'above' END AS side FROM l JOIN md USING ("column"))
  SELECT "column", side, count(frac) AS n, {r('1.48::DOUBLE * mad(frac)')} AS scatter FROM s GROUP BY 1, 2""")
def split_scatter(spark, sf):
    return round_all(ev.split_scatter(messy(spark, sf), ["l_quantity", "snr"]))


_QQ = [0.005 + i * 0.99 / 20 for i in range(21)]


@query("qq_table", f"""WITH {CLEAN}, m AS (SELECT sample, greatest(-12, least(12, {CHI})) AS z FROM cat WHERE {CHI} IS NOT NULL),
  q(p, normal) AS (VALUES {", ".join(f"({p!r}::DOUBLE, {ev.normal_quantile(p)!r}::DOUBLE)" for p in _QQ)}),
  e AS (SELECT sample, quantile_cont(z, {_QQ}) AS qs FROM m GROUP BY sample),
  u AS (SELECT sample, unnest({_QQ}::DOUBLE[]) AS p, unnest(qs) AS z FROM e)
  SELECT sample, {r('p')} AS p, {r('normal')} AS normal, {r('z')} AS empirical FROM u JOIN q USING (p)""")
def qq_table(spark, sf):
    return round_all(ev.qq_table(messy(spark, sf), ["sample"], _QQ))


@query("sigma_saturation", f"""WITH {CLEAN}
  SELECT sample, count(err_sp) AS n, {r("avg((err_sp / 10 <= 1e-4::DOUBLE * 1.01)::INT::DOUBLE)")} AS at_floor,
    {r("avg((err_sp / 10 >= 10 * 0.99::DOUBLE)::INT::DOUBLE)")} AS at_ceiling
  FROM cat WHERE err_sp IS NOT NULL GROUP BY sample""")
def sigma_saturation(spark, sf):
    return round_all(ev.saturation(messy(spark, sf), ["sample"], std_factor=10.0))


@query("honesty_budget", f"""WITH {CLEAN}, g AS (SELECT train, 1 / (1 + exp(-((4 - l_quantity / 10) / 0.5))) AS gate,
    l_quantity / 10 AS hull_d FROM cat)
  SELECT count(*) AS n_train, {r('avg((gate < 0.5)::INT::DOUBLE)')} AS gate_lt_half, {r('median(gate)')} AS gate_median,
    {r('median(hull_d)')} AS hull_median, {r('quantile_cont(hull_d, 0.99)')} AS hull_p99 FROM g WHERE train""")
def honesty_budget(spark, sf):
    cat = messy(spark, sf).withColumns({
        "hull_d": F.col("l_quantity") / 10,
        "gate": x.sigmoid((4 - F.col("l_quantity") / 10) / 0.5)})
    return round_all(ev.honesty_budget(cat))


@query("value_digest", f"""WITH {CLEAN}, t AS (SELECT concat_ws('|', sdss_id::VARCHAR,
    coalesce(round(plx_sp * 1e4)::BIGINT::VARCHAR, 'null'), coalesce(round(plx * 1e4)::BIGINT::VARCHAR, 'null')) AS s FROM cat)
  SELECT count(*) AS n_rows, (sum(('0x' || substr(md5(s), 1, 15))::BIGINT::HUGEINT) % 9223372036854775808::HUGEINT)::BIGINT AS digest FROM t""")
def value_digest(spark, sf):
    return ev.value_digest(ev.clean_catalog(messy(spark, sf)), "sdss_id", ["plx_sp", "plx"], digits=4)


@query("spec_vs_parallax_table", f"""WITH {CLEAN}
  SELECT sdss_id, {r('plx + 0.048', 9)} AS plx, {r('plx_sp / plx', 9)} AS ratio, {r('snr', 9)} AS snr, {PROBE} AS probe
  FROM cat WHERE train AND plx IS NOT NULL""")
def spec_vs_parallax_table(spark, sf):
    cat = ev.clean_catalog(messy(spark, sf)).filter(F.col("train") & F.col("plx").isNotNull())
    return round_all(cat.select("sdss_id", (F.col("plx") + 0.048).alias("plx"),
                                x.ratio("plx_sp", "plx").alias("ratio"), "snr",
                                x.hi_snr("plx", "e_plx").alias("probe")), 9)


@query("distance_vs_magnitude_table", f"""WITH {CLEAN}, m AS (SELECT sdss_id, p_retailprice / 100 AS g_mag, 1 / plx_sp AS d,
    log10(nullif(e_plx / nullif(err_sp, 0), 0)) AS q FROM cat LEFT JOIN part ON l_partkey = p_partkey)
  SELECT sdss_id, {r('g_mag')} AS g_mag, {r('d')} AS dist_kpc, {r('q')} AS log_ratio FROM m
  WHERE q IS NOT NULL AND d > 0 AND d < 20""")
def distance_vs_magnitude_table(spark, sf):
    mags = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("g_mag"))
    cat = ev.clean_catalog(messy(spark, sf)).join(mags, F.col("l_partkey") == F.col("p_partkey"), "left")
    out = cat.select("sdss_id", "g_mag", x.distance_kpc("plx_sp").alias("dist_kpc"),
                     x.log_precision_ratio("e_plx", "err_sp").alias("log_ratio"))
    return round_all(out.filter(F.col("log_ratio").isNotNull() & (F.col("dist_kpc") > 0)
                                & (F.col("dist_kpc") < 20)))
