"""Queries over array columns; spectra are derived from the embedding vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyledger.operators import spectra as sp
from skyledger.plans.registry import query
from skyledger.plans.tables import r, round_all, table

TELESCOPES = ["apo1m", "apo25m", "lco25m", "other"]


def spectra(spark, sf):
    """64-pixel spectra with gaps, bad weights, missing and runaway pixels."""
    e = table(spark, sf, "embeddings")
    f = F.transform("embedding", lambda v, p: F.when((p + F.col("vec_id")) % 101 == 0, F.lit(float("nan")))
                    .when((p + 3 * F.col("vec_id")) % 211 == 0, F.lit(9.0)).otherwise(v + 1.0).cast("float"))
    c = F.transform("embedding", lambda v, p: F.when((p == 5) & (F.col("label") == 9), 0.0)
                    .otherwise(1.0 + 0.1 * F.col("label")).cast("float"))
    iv = F.transform("embedding", lambda v, p: F.when((p >= 58) | ((p * F.col("vec_id") + 7) % 197 == 0), 0.0)
                     .otherwise(100.0 + p).cast("float"))
    fl = F.transform("embedding", lambda v, p: F.when(((p * 13 + F.col("vec_id")) % 40 == 0) & (p % 9 != F.col("label") % 4),
                                                      p % 5 + 1).otherwise(0).cast("int"))
    return e.select(F.col("vec_id").alias("sdss_id"),
                    F.element_at(F.array(*[F.lit(t) for t in TELESCOPES]), F.col("label") % 4 + 1).alias("telescope"),
                    "label", f.alias("flux"), c.alias("continuum"), iv.alias("ivar"), fl.alias("pixel_flags"))


PIX = """px AS (SELECT vec_id AS sdss_id, label, ['apo1m', 'apo25m', 'lco25m', 'other'][label % 4 + 1] AS telescope, p, (CASE WHEN (p + vec_id) % 101 = 0 THEN 'nan'::DOUBLE
    WHEN (p + 3 * vec_id) % 211 = 0 THEN 9.0 ELSE (e + 1.0::FLOAT)::DOUBLE END)::FLOAT::DOUBLE AS flux,
  (CASE WHEN p = 5 AND label = 9 THEN 0.0 ELSE 1.0::DOUBLE + 0.1::DOUBLE * label END)::FLOAT::DOUBLE AS cont,
  (CASE WHEN p >= 58 OR (p * vec_id + 7) % 197 = 0 THEN 0.0 ELSE 100.0 + p END)::FLOAT::DOUBLE AS ivar,
  CASE WHEN (p * 13 + vec_id) % 40 = 0 AND p % 9 <> label % 4 THEN p % 5 + 1 ELSE 0 END AS flag
  FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"""
FLAGGED = PIX + """, nx AS (SELECT *, flux / nullif(cont, 0) AS f FROM px),
  bx AS (SELECT *, NOT coalesce(isfinite(f) AND isfinite(ivar) AND ivar > 0 AND f > 0 AND f <= 2, false) AS bad FROM nx),
  lit AS (SELECT telescope, p, sum((flag <> 0)::INT) > 0 AS lit FROM px GROUP BY 1, 2),
  mx AS (SELECT bx.*, bad OR (telescope <> 'other' AND NOT lit.lit) AS badm FROM bx JOIN lit USING (telescope, p)),
  good AS (SELECT p FROM mx GROUP BY p HAVING sum(badm::INT) < 0.5 * count(*))"""


def masks(df):
    counts = sp.hit_counts(df).filter("telescope <> 'other'")
    return sp.load_masks(sp.lit_masks(counts))


def exploded(df, carry, column):
    return df.select(*carry, F.posexplode(column).alias("p", "v"))


@query("spectrum_ln_flux", f"""WITH {FLAGGED} SELECT sdss_id, (dense_rank() OVER (ORDER BY p) - 1)::INT AS p,
  {r('(CASE WHEN badm THEN 0.0 ELSE ln(f) END)::FLOAT')} AS v FROM mx WHERE p IN (SELECT p FROM good)""")
def spectrum_ln_flux(spark, sf):
    df = spectra(spark, sf)
    m = masks(df)
    good = sp.good_pixels(sp.bad_counts(df, m), 0.5)
    return round_all(exploded(sp.ln_flux(df, ["sdss_id"], good=good, masks=m), ["sdss_id"], "ln_flux"))


@query("spectrum_bad_fraction", f"WITH {FLAGGED} SELECT sdss_id, {r('(sum(bad::INT) / count(*))::FLOAT')} AS spec_bad_frac FROM mx GROUP BY 1")
def spectrum_bad_fraction(spark, sf):
    df = spectra(spark, sf)
    return round_all(sp.ln_flux(df, ["sdss_id"], masks=masks(df)).select("sdss_id", "spec_bad_frac"))


@query("pixel_hit_counts", f"WITH {PIX} SELECT telescope, p::INT AS pixel, sum((flag <> 0)::INT)::BIGINT AS hits, count(*) AS n FROM px GROUP BY 1, 2")
def pixel_hit_counts(spark, sf):
    return sp.hit_counts(spectra(spark, sf))


@query("lit_masks", f"WITH {FLAGGED}, s AS (SELECT telescope, count(DISTINCT sdss_id) AS n_spectra FROM px GROUP BY 1) SELECT telescope, p::INT AS p, lit AS v, n_spectra FROM lit JOIN s USING (telescope)")
def lit_masks(spark, sf):
    return exploded(sp.lit_masks(sp.hit_counts(spectra(spark, sf))), ["telescope", "n_spectra"], "lit")


@query("unknown_telescopes", f"WITH {PIX} SELECT telescope, count(DISTINCT sdss_id) AS n FROM px WHERE telescope = 'other' GROUP BY 1")
def unknown_telescopes(spark, sf):
    df = spectra(spark, sf)
    return sp.unknown_telescopes(df, masks(df))


@query("pixel_bad_counts", f"WITH {FLAGGED} SELECT p::INT AS pixel, sum(badm::INT)::BIGINT AS hits, count(*) AS n FROM mx GROUP BY 1")
def pixel_bad_counts(spark, sf):
    df = spectra(spark, sf)
    return sp.bad_counts(df, masks(df))


@query("unusable_pixels", f"WITH {PIX} SELECT p::INT AS pixel, sum((NOT coalesce(isfinite(flux) AND flux > 0, false))::INT)::BIGINT AS hits, count(*) AS n FROM px GROUP BY 1")
def unusable_pixels(spark, sf):
    return sp.unusable_counts(spectra(spark, sf))


@query("hit_fraction_histogram", f"""WITH {PIX}, c AS (SELECT telescope, p, sum((flag <> 0)::INT) / count(*) AS share FROM px GROUP BY 1, 2),
  b AS (SELECT telescope, least(floor(share * 10), 9)::INT AS bin, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT DISTINCT telescope, range::INT AS bin FROM c, range(10))
  SELECT telescope, bin, {r('bin / 10.0')} AS bin_lo, {r('(bin + 1) / 10.0')} AS bin_hi, coalesce(n, 0) AS n FROM t LEFT JOIN b USING (telescope, bin)""")
def hit_fraction_histogram(spark, sf):
    return round_all(sp.hit_fraction_histogram(sp.hit_counts(spectra(spark, sf))))


@query("normalised_flux", f"""WITH {PIX}, n AS (SELECT *, flux / nullif(cont, 0) AS f, ivar * cont * cont AS w FROM px),
  g AS (SELECT *, coalesce(isfinite(f) AND isfinite(w) AND w > 0 AND f > 0 AND f <= 2, false) AS ok FROM n)
  SELECT sdss_id, {r('sum(CASE WHEN ok THEN f ELSE 1 END)')} AS flux, {r('sum(CASE WHEN ok THEN w ELSE 0 END)', 5)} AS ivar FROM g GROUP BY 1""")
def normalised_flux(spark, sf):
    df = sp.normalised_flux(spectra(spark, sf), ["sdss_id"])

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return df.select("sdss_id", F.round(total("norm_flux"), 6).alias("flux"), F.round(total("norm_ivar"), 5).alias("ivar"))


@query("select_pixels", f"WITH {PIX} SELECT sdss_id, (p // 3)::INT AS p, {r('ivar')} AS v FROM px WHERE p % 3 = 0")
def select_pixels(spark, sf):
    df = spectra(spark, sf).select("sdss_id", sp.select_pixels("ivar", [i % 3 == 0 for i in range(64)]).alias("a"))
    return round_all(exploded(df, ["sdss_id"], "a"))


@query("assemble_features", f"""WITH a AS (SELECT vec_id AS sdss_id, list_concat([(label / 10.0)::FLOAT, (vec_id % 7)::FLOAT, (0.918::DOUBLE * (label / 10.0::DOUBLE - vec_id % 7 - 0.08::DOUBLE))::FLOAT], embedding) AS a FROM embeddings)
  SELECT sdss_id, unnest(a)::FLOAT AS v0, generate_subscripts(a, 1)::INT - 1 AS p FROM a""".replace("unnest(a)::FLOAT AS v0", r("unnest(a)") + " AS v"))
def assemble_features(spark, sf):
    from skyledger.functions.exprs import rjce_extinction
    e = table(spark, sf, "embeddings").withColumns({"h": F.col("label") / 10, "w2": (F.col("vec_id") % 7).cast("double")})
    e = e.withColumn("a_ks", rjce_extinction("h", "w2"))
    df = e.select(F.col("vec_id").alias("sdss_id"), sp.assemble_features(["h", "w2"], "embedding", "a_ks").alias("a"))
    return round_all(exploded(sp.check_width(df, "a", 67), ["sdss_id"], "a"))


@query("spectral_region", f"""WITH {FLAGGED} SELECT sdss_id, count(*) AS n, {r('sum(ivar)')} AS total FROM px JOIN lit USING (telescope, p)
  WHERE lit AND 15100 + 30 * p BETWEEN 15400 AND 16600 GROUP BY 1""")
def spectral_region(spark, sf):
    df = spectra(spark, sf)
    lit = sp.lit_masks(sp.hit_counts(df)).select("telescope", "lit")
    df = df.join(lit, "telescope").withColumn("wavelength", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: 15100.0 + 30 * p))
    part = df.select("sdss_id", sp.region("wavelength", "lit", "ivar", 15400, 16600).alias("v"))
    return round_all(part.select("sdss_id", F.size("v").cast("long").alias("n"),
                                 F.aggregate("v", F.lit(0.0), lambda a, v: a + v).alias("total")).filter("n > 0"))


@query("fill_missing_spectra", f"""WITH {PIX}, s AS (SELECT sdss_id, sum(ivar) AS w, sum(cont) AS c FROM px WHERE sdss_id % 4 <> 0 GROUP BY 1)
  SELECT vec_id AS sdss_id, s.sdss_id IS NOT NULL AS spectrum_ok, {r('coalesce(c, 0)', 4)} AS continuum, {r('coalesce(w, 0)', 4)} AS ivar FROM embeddings LEFT JOIN s ON vec_id = sdss_id""")
def fill_missing_spectra(spark, sf):
    meta = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sdss_id"))
    out = sp.fill_missing_spectra(meta, spectra(spark, sf).filter("sdss_id % 4 <> 0"), "sdss_id", 64)

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return round_all(out.select("sdss_id", "spectrum_ok", total("continuum").alias("continuum"), total("ivar").alias("ivar")), 4)


@query("spectrum_spot_check", f"""WITH {PIX} SELECT sdss_id, count(*) FILTER (ivar > 0)::INT AS n_good,
  {r("median(CASE WHEN isnan(flux) THEN 1e300 ELSE flux / cont END) FILTER (ivar > 0 AND cont <> 0)")} AS median_flux FROM px GROUP BY 1""")
def spectrum_spot_check(spark, sf):
    return round_all(sp.spot_check(spectra(spark, sf), ["sdss_id"]))


@query("mask_uniformity", f"""WITH {PIX}, f AS (SELECT telescope, min(sdss_id) AS ref FROM px GROUP BY 1), rf AS (SELECT px.telescope, p, flag AS rflag FROM px JOIN f ON px.telescope = f.telescope AND sdss_id = ref),
  d AS (SELECT px.telescope, sdss_id, sum((flag <> rflag)::INT) AS d FROM px JOIN rf USING (telescope, p) GROUP BY 1, 2), k AS (SELECT telescope, sum((rflag <> 0)::INT) AS fl FROM rf GROUP BY 1)
  SELECT telescope, count(*) AS n_spectra, count(*) FILTER (d > 0) AS n_differ, max(d)::INT AS max_pixels_differ, any_value(fl)::INT AS n_flagged_reference FROM d JOIN k USING (telescope) GROUP BY 1""")
def mask_uniformity(spark, sf):
    return sp.mask_uniformity(spectra(spark, sf), "telescope", "pixel_flags", "sdss_id")


@query("feature_stats", f"""WITH p AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
  SELECT i::INT AS feature, {r('avg(v)')} AS mu, {r('stddev_pop(v)')} AS sd FROM p GROUP BY 1""")
def feature_stats(spark, sf):
    mu, sd, _ = sp.feature_stats(table(spark, sf, "embeddings"), "embedding")
    out = spark.createDataFrame([(i, float(m), float(s)) for i, (m, s) in enumerate(zip(mu, sd))],
                                "feature int, mu double, sd double")
    return round_all(out)


@query("standardised_features", f"""WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
  s AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM p WHERE vec_id % 2 = 0 GROUP BY 1)
  SELECT vec_id, i::INT AS p, {r('(v - mu) / sd')} AS v FROM p JOIN s USING (i)""")
def standardised_features(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    mu, sd, _ = sp.feature_stats(e, where=F.col("vec_id") % 2 == 0)
    return round_all(exploded(sp.standardise(e, mu, sd), ["vec_id"], "features"))


WAVE = 15100.0 + 30.0 * np.arange(64)


# Pixels of the three windows on WAVE; parabolas by Cramer's rule on the weighted normal equations.
_CONTINUUM = PIX + """, a AS (SELECT sdss_id, p, ok, CASE WHEN ok THEN flux ELSE 1.0::DOUBLE END AS f, CASE WHEN ok THEN 1 / sqrt(ivar) ELSE 3.0::DOUBLE END AS s,
    CASE WHEN p BETWEEN 2 AND 23 THEN 1 WHEN p BETWEEN 27 AND 44 THEN 2 WHEN p BETWEEN 47 AND 61 THEN 3 END AS win,
    CASE WHEN p <= 23 THEN (p - 12.5::DOUBLE) / 10.5 WHEN p <= 44 THEN (p - 35.5::DOUBLE) / 8.5 ELSE (p - 54.0::DOUBLE) / 7 END AS t
    FROM (SELECT *, coalesce(isfinite(flux), false) AND ivar > 0 AS ok FROM px)),
  b AS (SELECT *, (1 / (s * s + CASE WHEN p % 4 = 1 THEN 9 ELSE 0 END)) ** 2 AS w FROM a WHERE win IS NOT NULL),
  n AS (SELECT sdss_id, win, sum(w) AS s0, sum(w * t) AS s1, sum(w * t ** 2) AS s2, sum(w * t ** 3) AS s3, sum(w * t ** 4) AS s4,
    sum(w * f) AS b0, sum(w * f * t) AS b1, sum(w * f * t * t) AS b2 FROM b GROUP BY 1, 2),
  c AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM n),
  k AS (SELECT sdss_id, win, (b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - s3 * b2) + s2 * (b1 * s3 - s2 * b2)) / det AS c0,
    (s0 * (b1 * s4 - b2 * s3) - b0 * (s1 * s4 - s3 * s2) + s2 * (s1 * b2 - b1 * s2)) / det AS c1,
    (s0 * (s2 * b2 - s3 * b1) - s1 * (s1 * b2 - b1 * s2) + b0 * (s1 * s3 - s2 * s2)) / det AS c2 FROM c),
  v AS (SELECT a.*, coalesce(c0 + c1 * t + c2 * t * t, 0) AS level FROM a LEFT JOIN k ON a.sdss_id = k.sdss_id AND a.win = k.win),
  u AS (SELECT *, level > 0 AND s / nullif(level, 0) <= 0.3 AS sure FROM v),
  g AS (SELECT x.sdss_id, count(*) AS n_good, sum(x.level::FLOAT::DOUBLE) AS total FROM u x JOIN u l ON l.sdss_id = x.sdss_id AND l.p = (x.p + 63) % 64
    JOIN u h ON h.sdss_id = x.sdss_id AND h.p = (x.p + 1) % 64 WHERE x.sure AND l.sure AND h.sure AND x.ok GROUP BY 1)"""


@query("continuum_fit", f"""WITH {_CONTINUUM} SELECT vec_id AS sdss_id, coalesce(n_good, 0) AS n_good, {r('coalesce(total, 0)', 3)} AS continuum_sum
  FROM embeddings LEFT JOIN g ON vec_id = sdss_id""")
def continuum_fit(spark, sf):
    df = spectra(spark, sf).withColumn("sigma", F.transform("ivar", lambda v: F.when(v > 0, 1 / F.sqrt(v.cast("double"))).otherwise(0.0)))
    out = sp.fit_continuum(df, ["sdss_id"], WAVE, np.arange(64) % 4 != 1)
    good = F.filter(F.arrays_zip("continuum", "ivar"), lambda s: s["ivar"] > 0)
    return round_all(out.select("sdss_id", F.size(good).alias("n_good"), F.aggregate(
        good, F.lit(0.0), lambda a, s: a + s["continuum"]).alias("continuum_sum")), 3)
