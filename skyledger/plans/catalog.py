"""Queries for row cuts, one-row-per-key picks, splits and catalog statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import exprs as x, sky
from skyledger.operators import dedup, selection as sel, split
from skyledger.operators.quantiles import exact_quantiles
from skyledger.operators.robust import inverse_variance, numeric_summary, quantile_bins, robust_stats
from skyledger.plans.registry import query
from skyledger.plans.tables import CLEAN, HUB, MESSY, hub, messy, r, round_all, table


def fin(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} END"


# --- cuts and derived columns --------------------------------------------------
@query("finite_guard", f"""WITH {MESSY} SELECT sdss_id, {r(fin('plx'), 9)} AS plx, {r(fin('zeropoint'), 9)} AS zeropoint,
  coalesce(isfinite(e_plx), false) AS e_plx_ok FROM messy""")
def finite_guard(spark, sf):
    return round_all(messy(spark, sf).select("sdss_id", x.finite("plx").alias("plx"),
                                             x.finite("zeropoint").alias("zeropoint"),
                                             x.is_finite("e_plx").alias("e_plx_ok")), 9)


@query("complete_bands", f"""WITH {MESSY} SELECT sdss_id FROM messy
  WHERE coalesce(isfinite(plx) AND isfinite(e_plx) AND isfinite(zeropoint) AND isfinite(r_med_photogeo_pc), false)""")
def complete_bands(spark, sf):
    return sel.complete_bands(messy(spark, sf), ["plx", "e_plx", "zeropoint", "r_med_photogeo_pc"]).select("sdss_id")


@query("drop_failed_spectra", f"WITH {MESSY} SELECT cluster, count(*) AS n FROM messy WHERE spectrum_ok GROUP BY cluster")
def drop_failed_spectra(spark, sf):
    return sel.drop_failed_spectra(messy(spark, sf)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


_TRAIN = "coalesce(snr > 100 AND flags = 0 AND isfinite(plx) AND isfinite(e_plx) AND e_plx > 0, false)"


@query("training_flag", f"""WITH {MESSY} SELECT sdss_id, {_TRAIN} AS train,
  coalesce(isfinite(plx) AND isfinite(e_plx) AND e_plx > 0 AND train, false) AS train_override FROM messy""")
def training_flag(spark, sf):
    return messy(spark, sf).select(
        "sdss_id", sel.training_flag(flags="flags").alias("train"),
        sel.training_flag(override="train").alias("train_override"))


@query("sample_override", f"""WITH {HUB} SELECT sdss_id,
  CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'R' THEN 'B' ELSE sample END AS sample FROM hub""")
def sample_override(spark, sf):
    cat = hub(spark, sf).withColumn("given", F.concat(F.lit(" "), F.when(F.col("l_returnflag") == "R", "B")
                                                      .otherwise(F.col("l_returnflag"))))
    return cat.select("sdss_id", sel.sample_override("given", "sample").alias("sample"))


@query("zero_point", f"""WITH {MESSY}, m AS (SELECT sdss_id, {fin('plx')} AS p, {fin('zeropoint')} AS z FROM messy)
  SELECT sdss_id, {r('p - z', 9)} AS plx FROM m""")
def zero_point(spark, sf):
    cat = messy(spark, sf).withColumnRenamed("plx", "plx_raw")
    return round_all(sel.apply_zero_point(cat).select("sdss_id", "plx"), 9)


@query("zero_point_fallback", f"WITH {MESSY} SELECT sdss_id, {r(fin('plx'), 9)} AS plx FROM messy")
def zero_point_fallback(spark, sf):
    cat = messy(spark, sf).withColumnRenamed("plx", "plx_raw").withColumn("zeropoint", F.lit(float("nan")))
    return round_all(sel.apply_zero_point(cat).select("sdss_id", "plx"), 9)


@query("zero_point_counts", f"""WITH {MESSY} SELECT count(*) FILTER (coalesce(isfinite(zeropoint), false)) AS n_applied,
  count(*) FILTER (isfinite(plx) AND NOT coalesce(isfinite(zeropoint), false)) AS n_without FROM messy""")
def zero_point_counts(spark, sf):
    return sel.zero_point_counts(messy(spark, sf), plx="plx")


@query("hi_snr_probe", f"""WITH {CLEAN} SELECT sample, count(*) FILTER (plx / nullif(e_plx, 0) >= 20) AS n_probe,
  count(*) FILTER (plx / nullif(e_plx, 0) >= 50) AS n_probe50 FROM cat GROUP BY sample""")
def hi_snr_probe(spark, sf):
    from skyledger.operators.evaluate import clean_catalog
    return clean_catalog(messy(spark, sf)).groupBy("sample").agg(
        F.count_if(x.hi_snr("plx", "e_plx")).alias("n_probe"),
        F.count_if(x.hi_snr("plx", "e_plx", 50)).alias("n_probe50"))


@query("warm_start_rows", f"WITH {CLEAN} SELECT sdss_id FROM cat WHERE plx > 0 AND e_plx > 0 AND plx / e_plx > 5")
def warm_start_rows(spark, sf):
    return sel.warm_start_rows(messy(spark, sf)).select("sdss_id")


@query("astrometric_solutions", "SELECT l_orderkey, l_linenumber, l_partkey, [3, 31, 95][l_partkey % 3 + 1] AS solved "
       "FROM lineitem WHERE [3, 31, 95][l_partkey % 3 + 1] IN (31, 95)")
def astrometric_solutions(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.element_at(F.array(F.lit(3), F.lit(31), F.lit(95)), (F.col("l_partkey") % 3 + 1).cast("int")).alias("solved"))
    return sel.astrometric_solutions(li, "solved")


@query("clean_spectra", f"WITH {MESSY} SELECT sdss_id FROM messy WHERE flags = 0 AND snr >= 150")
def clean_spectra(spark, sf):
    return sel.clean_spectra(messy(spark, sf), snr_min=150, flags="flags").select("sdss_id")


_PHOT = """phot AS (SELECT p_partkey, p_retailprice / 100.0::DOUBLE AS bp, p_size / 20.0::DOUBLE AS j,
  p_size / 40.0::DOUBLE + (p_partkey % 13) / 20.0::DOUBLE AS k, (p_partkey % 29) / 10.0::DOUBLE AS logg,
  (p_partkey % 17) / 100.0::DOUBLE AS err, p_partkey % 14 AS vis, p_partkey % 300 + 1.5::DOUBLE AS chi2,
  p_partkey % 31 AS ngood FROM part)"""


def _phot(spark, sf):
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", (F.col("p_retailprice") / 100.0).alias("bp"), (F.col("p_size") / 20.0).alias("j"),
        (F.col("p_size") / 40.0 + (p % 13) / 20.0).alias("k"), ((p % 29) / 10.0).alias("logg"),
        ((p % 17) / 100.0).alias("err"), (p % 14).alias("vis"), (p % 300 + 1.5).alias("chi2"),
        (p % 31).alias("ngood"))


@query("colour_cuts", f"""WITH {_PHOT} SELECT p_partkey, j - k < 0.4 + 0.45 * (bp - 9.5) AS jk, j - k > -0.05::DOUBLE AS hw2,
  logg > 0 AND logg <= 2.2 AS giant FROM phot""")
def colour_cuts(spark, sf):
    df = _phot(spark, sf).withColumn("rp", F.lit(9.5))
    return df.select("p_partkey", sel.colour_cut_jk("j", "k", "bp", "rp").alias("jk"),
                     sel.colour_cut_hw2("j", "k").alias("hw2"), sel.giant_gravity("logg").alias("giant"))


@query("astrometric_quality_agreement", f"""WITH {_PHOT}, d AS (SELECT *, coalesce(err < 0.1 AND vis >= 8 AND
    chi2 / sqrt(CASE WHEN ngood > 5 THEN ngood - 5 END) <= 35, false) AS derived FROM phot)
  SELECT count(*) AS n, count(*) FILTER (derived) AS n_derived, count(*) FILTER (derived = (p_partkey % 2 = 0)) AS n_agree FROM d""")
def astrometric_quality_agreement(spark, sf):
    return sel.flag_agreement(_phot(spark, sf), sel.astrometric_quality("err", "vis", "chi2", "ngood"),
                              F.col("p_partkey") % 2 == 0)


@query("rjce_extinction", f"WITH {_PHOT} SELECT p_partkey, {r('0.918 * (j - k - 0.08)')} AS a_ks, NULL::DOUBLE AS a_none FROM phot")
def rjce_extinction(spark, sf):
    return round_all(_phot(spark, sf).select("p_partkey", x.rjce_extinction("j", "k").alias("a_ks"),
                                             x.rjce_extinction(None, None).alias("a_none")))


@query("sentinel_fallback", f"""WITH {_PHOT}, s AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN -9999 ELSE logg END AS v,
    CASE WHEN p_partkey % 3 = 0 THEN -9999 ELSE k - 0.3 END AS f FROM phot),
  c AS (SELECT p_partkey, CASE WHEN v > 0 THEN v WHEN f > -100 THEN f END AS q FROM s)
  SELECT p_partkey, {r('CASE WHEN q > 0 THEN q END')} AS logg FROM c""")
def sentinel_fallback(spark, sf):
    df = _phot(spark, sf).withColumns({
        "v": F.when(F.col("p_partkey") % 5 == 0, -9999.0).otherwise(F.col("logg")),
        "f": F.when(F.col("p_partkey") % 3 == 0, -9999.0).otherwise(F.col("k") - 0.3)})
    return round_all(df.select("p_partkey", sel.sentinel_fallback("v", "f").alias("logg")))


@query("membership_cut", f"""WITH {MESSY} SELECT cluster, count(*) AS n FROM messy
  WHERE (CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity / 50 END) >= 0.7 GROUP BY cluster""")
def membership_cut(spark, sf):
    df = messy(spark, sf).withColumn("prob", F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity") / 50))
    return sel.membership_cut(df, "prob", 0.7).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("range_view", f"WITH {CLEAN} SELECT sdss_id FROM cat WHERE plx > 0 AND plx < 2 AND e_plx < 0.05 AND snr > 100")
def range_view(spark, sf):
    return sel.range_view(messy(spark, sf), plx=(0, 2), e_plx=(None, 0.05), snr=(100, None)).select("sdss_id")


@query("distances", f"""WITH {HUB} SELECT sdss_id, {r('1 / plx_sp')} AS dist_kpc, {r('l_partkey / 1000.0')} AS pc_kpc,
  {r('10 - 5 / ln(10::DOUBLE) * ln(plx_sp)')} AS mu FROM hub""")
def distances(spark, sf):
    return round_all(hub(spark, sf).select("sdss_id", x.distance_kpc("plx_sp").alias("dist_kpc"),
                                           x.pc_to_kpc("l_partkey").alias("pc_kpc"),
                                           x.distance_modulus(F.ln("plx_sp")).alias("mu")))


@query("missing_counts", f"""WITH {MESSY}
  SELECT 'plx' AS "column", count(*) FILTER (NOT coalesce(isfinite(plx), false)) AS n_missing FROM messy
  UNION ALL SELECT 'e_plx', count(*) FILTER (NOT coalesce(isfinite(e_plx), false)) FROM messy
  UNION ALL SELECT 'zeropoint', count(*) FILTER (NOT coalesce(isfinite(zeropoint), false)) FROM messy""")
def missing_counts(spark, sf):
    return sel.missing_counts(messy(spark, sf), ["plx", "e_plx", "zeropoint"])


@query("zero_point_summary", f"""WITH {MESSY}, z AS (SELECT {fin('zeropoint')} AS z FROM messy WHERE [3, 31, 95][l_partkey % 3 + 1] IN (31, 95))
  SELECT 'zeropoint' AS "column", count(z) AS n, count(*) FILTER (z IS NULL) AS n_missing, {r('avg(z)')} AS mean,
    {r('min(z)')} AS min, {r('max(z)')} AS max, {r('median(z)')} AS median FROM z""")
def zero_point_summary(spark, sf):
    cat = messy(spark, sf).withColumn("solved", F.element_at(
        F.array(F.lit(3), F.lit(31), F.lit(95)), (F.col("l_partkey") % 3 + 1).cast("int")))
    return round_all(numeric_summary(sel.astrometric_solutions(cat, "solved"), ["zeropoint"]))


# --- one row per key -----------------------------------------------------------
_KEY = "l_orderkey * 8 + l_linenumber"


def _visits(spark, sf):
    return messy(spark, sf).withColumn("star", F.col("l_orderkey") * 8 + F.col("l_linenumber"))


@query("keep_most_complete", f"""WITH {MESSY}, k AS (SELECT {_KEY} AS star, *, row_number() OVER (PARTITION BY {_KEY} ORDER BY
    (NOT coalesce(isfinite(plx), false))::INT + (NOT coalesce(isfinite(e_plx), false))::INT
    + (NOT coalesce(isfinite(zeropoint), false))::INT, sdss_id) AS rn FROM messy)
  SELECT star, sdss_id, {r(fin('plx'), 9)} AS plx, e_plx IS NULL AS no_error FROM k WHERE rn = 1""")
def keep_most_complete(spark, sf):
    cols = ["plx", "e_plx", "zeropoint"]
    out = dedup.keep_most_complete(_visits(spark, sf).select("star", "sdss_id", *cols), ["star"], cols, ["sdss_id"])
    return round_all(out.select("star", "sdss_id", x.finite("plx").alias("plx"),
                                F.col("e_plx").isNull().alias("no_error")), 9)


@query("keep_highest_snr", f"""WITH {MESSY}, k AS (SELECT {_KEY} AS star, sdss_id, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE snr END AS s
    FROM messy), n AS (SELECT *, row_number() OVER (PARTITION BY star ORDER BY s DESC NULLS LAST, sdss_id) AS rn FROM k)
  SELECT star, sdss_id, {r('s')} AS s FROM n WHERE rn = 1""")
def keep_highest_snr(spark, sf):
    df = _visits(spark, sf).select("star", "sdss_id", F.when(F.col("l_partkey") % 5 != 0, F.col("snr")).alias("s"))
    return round_all(dedup.keep_highest(df, ["star"], "s", ["sdss_id"]))


@query("keep_nearest", f"""WITH {HUB}, n AS (SELECT {_KEY} AS star, sdss_id, l_quantity AS sep,
    row_number() OVER (PARTITION BY {_KEY} ORDER BY l_quantity, sdss_id) AS rn,
    count(*) OVER (PARTITION BY {_KEY}) AS n_in_radius FROM hub)
  SELECT star, sdss_id, {r('sep')} AS sep, n_in_radius FROM n WHERE rn = 1""")
def keep_nearest(spark, sf):
    df = _visits(spark, sf).select("star", "sdss_id", F.col("l_quantity").alias("sep"))
    return round_all(dedup.keep_nearest(df, ["star"], "sep", ["sdss_id"]))


@query("keep_first", "SELECT l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_suppkey")
def keep_first(spark, sf):
    return dedup.keep_first(table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey"), ["l_suppkey"], ["l_orderkey"])


@query("duplicate_counts", """SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys,
  count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_dropped FROM lineitem""")
def duplicate_counts(spark, sf):
    return dedup.duplicate_counts(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("claimed_by_many", """SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_groups FROM lineitem
  GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1""")
def claimed_by_many(spark, sf):
    return dedup.claimed_by_many(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


# --- splits --------------------------------------------------------------------
@query("exact_half_split", f"""WITH {HUB}, k AS (SELECT sdss_id, train, md5('42-' || sdss_id) AS h FROM hub),
  n AS (SELECT *, row_number() OVER (PARTITION BY train ORDER BY h, sdss_id) AS rn, count(*) OVER (PARTITION BY train) AS n FROM k)
  SELECT sdss_id, train, CASE WHEN rn <= n // 2 THEN 'A' ELSE 'B' END AS sample FROM n""")
def exact_half_split(spark, sf):
    cat = hub(spark, sf).select("sdss_id", "train")
    return split.exact_half_split(cat, ["train"], ["sdss_id"])


# crc32('NATION_<k>') % 2 worked out once; the SQL engine has no crc32.
def _crc_case(names: list[str], column: str) -> str:
    import zlib
    even = ", ".join(f"'{n}'" for n in names if zlib.crc32(n.encode()) % 2 == 0)
    return f"CASE WHEN {column} IN ({even}) THEN 'A' ELSE 'B' END"


_NATIONS = [f"NATION_{i}" for i in range(25)]


@query("group_fold", f"SELECT n_name, {_crc_case(_NATIONS, 'n_name')} AS fold FROM nation")
def group_fold(spark, sf):
    return table(spark, sf, "nation").select("n_name", split.group_fold("n_name").alias("fold"))


@query("anchor_folds", f"""WITH a AS (SELECT s_suppkey, {_crc_case(_NATIONS, 'n_name')} AS fold FROM supplier
    JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0), {HUB}
  SELECT sdss_id, coalesce(fold, sample) AS sample FROM hub LEFT JOIN a ON l_suppkey = s_suppkey""")
def anchor_folds(spark, sf):
    anchors = (table(spark, sf, "supplier").filter(F.col("s_suppkey") % 3 == 0)
               .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
               .select(F.col("s_suppkey").alias("l_suppkey"), "n_name"))
    return split.reassign_groups(hub(spark, sf), anchors, "l_suppkey", "n_name").select("sdss_id", "sample")


@query("anchor_group_sizes", f"""SELECT n_name, {_crc_case(_NATIONS, 'n_name')} AS fold, count(*) AS n FROM supplier
  JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def anchor_group_sizes(spark, sf):
    anchors = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return anchors.groupBy("n_name").agg(F.count(F.lit(1)).alias("n")).withColumn("fold", split.group_fold("n_name"))


# --- statistics ----------------------------------------------------------------
@query("grouped_quantiles", f"""WITH {CLEAN} SELECT cluster, {r('quantile_cont(plx, 0.1)', 9)} AS q10, {r('median(plx)', 9)} AS q50,
  {r('quantile_cont(plx, 0.9)', 9)} AS q90, {r('median(snr)', 9)} AS snr50 FROM cat GROUP BY cluster""")
def grouped_quantiles(spark, sf):
    from skyledger.operators.evaluate import clean_catalog
    q = exact_quantiles(clean_catalog(messy(spark, sf)), ["cluster"], ["plx", "snr"], [0.1, 0.5, 0.9])
    return round_all(q.select("cluster", F.col("plx")[0].alias("q10"), F.col("plx")[1].alias("q50"),
                              F.col("plx")[2].alias("q90"), F.col("snr")[1].alias("snr50")), 9)


@query("robust_scatter", f"""WITH {CLEAN} SELECT cluster, count(plx) AS n, {r('median(plx)', 9)} AS med,
  {r('1.48::DOUBLE * mad(plx)', 9)} AS scatter FROM cat GROUP BY cluster""")
def robust_scatter(spark, sf):
    from skyledger.operators.evaluate import clean_catalog
    out = robust_stats(clean_catalog(messy(spark, sf)).select("cluster", "plx"), ["cluster"], ["plx"])
    return round_all(out.select("cluster", F.col("plx_n").alias("n"), F.col("plx_med").alias("med"),
                                F.col("plx_scatter").alias("scatter")), 9)


@query("inverse_variance_mean", f"""WITH {CLEAN}, w AS (SELECT cluster, plx_sp AS v, 1 / (err_sp * err_sp) AS w FROM cat WHERE err_sp > 0)
  SELECT cluster, {r('sum(w * v) / sum(w)')} AS mean, {r('sqrt(1 / sum(w))')} AS err FROM w GROUP BY cluster""")
def inverse_variance_mean(spark, sf):
    mean, err = inverse_variance("plx_sp", "err_sp")
    return round_all(messy(spark, sf).groupBy("cluster").agg(mean.alias("mean"), err.alias("err")))


@query("conditional_shares", f"""WITH {CLEAN} SELECT sample, count(*) AS n, count(*) FILTER (plx < 0) AS n_negative,
  {r('avg(coalesce(plx < 0, false)::INT::DOUBLE)')} AS negative_share, {r('100 * avg(train::INT::DOUBLE)')} AS train_pct FROM cat GROUP BY sample""")
def conditional_shares(spark, sf):
    from skyledger.operators.evaluate import clean_catalog
    from skyledger.operators.robust import fraction
    return round_all(clean_catalog(messy(spark, sf)).groupBy("sample").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("plx") < 0).alias("n_negative"),
        fraction(F.col("plx") < 0).alias("negative_share"),
        (100 * fraction(F.col("train"))).alias("train_pct")))


@query("group_sizes", "SELECT count(*) AS n_groups, max(n) AS largest FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)")
def group_sizes(spark, sf):
    df = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return df.agg(F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest"))


@query("quantile_bin_assignment", f"""WITH {HUB}, e AS (SELECT sample, quantile_cont(plx, [0.2, 0.4, 0.6, 0.8]) AS e FROM hub GROUP BY sample)
  SELECT sdss_id, (plx >= e[1])::INT + (plx >= e[2])::INT + (plx >= e[3])::INT + (plx >= e[4])::INT AS bin FROM hub JOIN e USING (sample)""")
def quantile_bin_assignment(spark, sf):
    return quantile_bins(hub(spark, sf), ["sample"], "plx", 5).select("sdss_id", "bin")


@query("ordinal_ranks", f"""WITH {HUB} SELECT sdss_id, row_number() OVER (PARTITION BY sample ORDER BY l_quantity, sdss_id) AS rank FROM hub""")
def ordinal_ranks(spark, sf):
    from skyledger.operators.ranking import ordinal_rank
    return ordinal_rank(hub(spark, sf).select("sdss_id", "sample", "l_quantity"), ["sample"],
                        ["l_quantity", "sdss_id"], "rank").select("sdss_id", "rank")


@query("rank_correlation", """WITH k AS (SELECT row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS a,
    row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem)
  SELECT count(*) AS n, """ + r("corr(a, b)") + " AS rho FROM k")
def rank_correlation(spark, sf):
    from skyledger.operators.ranking import spearman
    return round_all(spearman(table(spark, sf, "lineitem"), [], "l_extendedprice", "l_quantity",
                              ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]))


# --- sky -----------------------------------------------------------------------
_POS = """pos AS (SELECT c_custkey, (c_custkey * 7919 % 360000) / 1000.0::DOUBLE AS ra,
  (c_custkey * 104729 % 170000) / 1000.0::DOUBLE - 85 AS dec FROM customer)"""
_RAD = "0.017453292519943295"
_GAL = f"""gal AS (SELECT c_custkey, degrees(asin(sin(radians(dec)) * sin(radians(27.12825)) + cos(radians(dec)) * cos(radians(27.12825)) * cos(radians(ra - 192.85948)))) AS b,
  122.93192 - degrees(atan2(cos(radians(dec)) * sin(radians(ra - 192.85948)),
    sin(radians(dec)) * cos(radians(27.12825)) - cos(radians(dec)) * sin(radians(27.12825)) * cos(radians(ra - 192.85948)))) AS l0 FROM pos),
  g AS (SELECT c_custkey, b, l0 + 180 - 360 * floor((l0 + 180) / 360) - 180 AS l FROM gal)"""


def positions(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_custkey") * 7919 % 360000 / 1000.0).alias("ra"),
        (F.col("c_custkey") * 104729 % 170000 / 1000.0 - 85).alias("dec"))


@query("galactic_footprint", f"""WITH {_POS}, {_GAL} SELECT c_custkey, {r('l')} AS l, {r('b')} AS b,
  abs(b) < 15 AND l > -70 AND l < 25 AS inside FROM g""")
def galactic_footprint(spark, sf):
    l, b = sky.galactic("ra", "dec")
    return round_all(positions(spark, sf).select("c_custkey", l.alias("l"), b.alias("b"),
                                                 sky.in_footprint("ra", "dec").alias("inside")))


@query("sky_box", f"""WITH {_POS}, o AS (SELECT c_custkey, ra, dec, abs((ra - 359.5 + 180) - 360 * floor((ra - 359.5 + 180) / 360) - 180) AS off FROM pos)
  SELECT c_custkey FROM o WHERE off <= 20 / cos(radians(40)) AND abs(dec - 40) <= 20""")
def sky_box(spark, sf):
    return positions(spark, sf).filter(sky.in_box("ra", "dec", F.lit(359.5), F.lit(40.0), 20.0)).select("c_custkey")
