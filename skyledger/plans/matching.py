"""Queries for joins, crosswalks, sky matching and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import joins, skymatch
from skyledger.plans.registry import query
from skyledger.plans.tables import HUB, LINE_ID, hub, line_id, r, round_all, table

# Stars: one row per customer. Reductions: orders, several per customer, with gaps.
STARS = """stars AS (SELECT o_custkey AS star, o_orderkey AS row_id,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 1000 END AS j_mag,
  CASE WHEN o_orderkey % 7 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice / 2000 END AS h_mag,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 100) / 10.0::DOUBLE END AS k_mag FROM orders)"""


def stars(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("star"), k.alias("row_id"),
        F.when(k % 5 != 0, F.col("o_totalprice") / 1000).alias("j_mag"),
        F.when(k % 7 == 0, float("nan")).otherwise(F.col("o_totalprice") / 2000).alias("h_mag"),
        F.when(k % 3 != 0, k % 100 / 10.0).alias("k_mag"))


def _fin(c):
    return f"CASE WHEN isfinite({c}) THEN {c} END"


_BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY star ORDER BY
    (NOT coalesce(isfinite(j_mag), false))::INT + (NOT coalesce(isfinite(h_mag), false))::INT
    + (NOT coalesce(isfinite(k_mag), false))::INT, row_id) AS rn FROM stars) WHERE rn = 1)"""


@query("attach_star_table", f"""WITH {STARS}, {_BEST} SELECT c_custkey AS star, {r('j_mag')} AS j_mag, {r(_fin('h_mag'))} AS h_mag, {r('k_mag')} AS k_mag
  FROM customer LEFT JOIN best ON c_custkey = star""")
def attach_star_table(spark, sf):
    spectra = table(spark, sf, "customer").select(F.col("c_custkey").alias("star"))
    out = joins.attach_star_table(spectra, stars(spark, sf), "star", ["j_mag", "h_mag", "k_mag"], ["row_id"])
    return round_all(out.withColumn("h_mag", F.nanvl("h_mag", F.lit(None).cast("double"))))


@query("override_bands", f"""WITH {STARS}, aux AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY star ORDER BY row_id) AS rn FROM stars) WHERE rn = 1)
  SELECT c_custkey AS star, {r(f"coalesce({_fin('j_mag')}, c_acctbal)")} AS j, {r(f"coalesce({_fin('h_mag')}, c_acctbal / 2)")} AS h,
    CASE WHEN coalesce(isfinite(j_mag) AND isfinite(h_mag), false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS survey_ind
  FROM customer LEFT JOIN aux ON c_custkey = star""")
def override_bands(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("star"), F.col("c_acctbal").alias("j"),
                                               (F.col("c_acctbal") / 2).alias("h"))
    out = joins.override_bands(base, stars(spark, sf), "star", {"j": "j_mag", "h": "h_mag"}, ["row_id"])
    return round_all(out)


@query("crosswalk_ids", """WITH x AS (SELECT o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 9000000000000000000 + o_orderkey END AS gaia_id, o_orderkey FROM orders),
  f AS (SELECT o_custkey, min_by(gaia_id, o_orderkey) AS gaia_id FROM x WHERE gaia_id <> 0 GROUP BY o_custkey)
  SELECT c_custkey, gaia_id FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def crosswalk_ids(spark, sf):
    xref = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(
        F.col("o_orderkey") % 4 == 0, F.lit(0).cast("long")).otherwise(F.lit(9000000000000000000) + F.col("o_orderkey")).alias("src"))
    cat = table(spark, sf, "customer").select("c_custkey")
    return joins.crosswalk(cat, xref, "c_custkey", "o_custkey", "src", "gaia_id", ["o_orderkey"])


@query("confirm_pairs", f"""WITH c AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), o AS (SELECT l_orderkey, l_suppkey, min(l_quantity) AS dist FROM lineitem GROUP BY 1, 2),
  b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY dist, l_suppkey) AS rn FROM c JOIN o USING (l_orderkey, l_suppkey))
  SELECT l_orderkey, l_suppkey, {r('dist')} AS dist FROM b WHERE rn = 1""")
def confirm_pairs(spark, sf):
    li = table(spark, sf, "lineitem")
    official = li.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_quantity").alias("dist"))
    return round_all(joins.confirm_pairs(li, official, ["l_orderkey", "l_suppkey"], "l_orderkey", "dist"))


@query("chained_left_joins", f"""SELECT l_orderkey, l_linenumber, l_partkey, c_name, p_name, {r('s_acctbal')} AS s_acctbal FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def chained_left_joins(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    out = li.join(o, "l_orderkey", "left").join(c, "o_custkey", "left").join(p, "l_partkey", "left").join(s, "l_suppkey", "left")
    return round_all(out.select("l_orderkey", "l_linenumber", "l_partkey", "c_name", "p_name", "s_acctbal"))


@query("members_only", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def members_only(spark, sf):
    ids = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.members_only(table(spark, sf, "lineitem"), ids, "l_orderkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("not_yet_done", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def not_yet_done(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return joins.not_in(table(spark, sf, "customer").select("c_custkey"), done, "c_custkey")


@query("match_normalised_ids", """WITH cat AS (SELECT c_custkey, ' 2m' || lower(c_name) || '2M' || (c_custkey % 500) AS cid FROM customer),
  k AS (SELECT replace(upper(trim(cid)), '2M', '') AS k, min(c_custkey) AS c_custkey FROM cat GROUP BY 1),
  m AS (SELECT o_orderpriority AS cluster, replace(upper(trim(c_name || (c_custkey % 500) || ' ')), '2M', '') AS k FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT DISTINCT cluster, c_custkey FROM m JOIN k USING (k)""")
def match_normalised_ids(spark, sf):
    c = table(spark, sf, "customer")
    suffix = (F.col("c_custkey") % 500).cast("string")
    cat = c.select("c_custkey", F.concat(F.lit(" 2m"), F.lower("c_name"), F.lit("2M"), suffix).alias("cid"))
    mem = (table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
           .select(F.col("o_orderpriority").alias("cluster"), F.concat("c_name", suffix, F.lit(" ")).alias("mid")))
    return joins.match_members(cat, mem, "cid", "mid", "cluster", "c_custkey", normalise=True)


_TGT = """tgt AS (SELECT c_custkey AS id, (c_custkey * 7919 % 3600) / 10.0::DOUBLE AS ra, (c_custkey * 104729 % 1400) / 10.0::DOUBLE - 70 AS dec FROM customer)"""
_SRC = """src AS (SELECT o_orderkey AS sid,
    CASE WHEN ra0 < 0 THEN ra0 + 360 ELSE ra0 END AS ra, dec FROM (
    SELECT o_orderkey, (o_custkey * 7919 % 3600) / 10.0::DOUBLE + (o_orderkey % 41 - 20) * 0.02::DOUBLE / 3600.0::DOUBLE AS ra0,
      (o_custkey * 104729 % 1400) / 10.0::DOUBLE - 70 + (o_orderkey % 37 - 18) * 0.02::DOUBLE / 3600.0::DOUBLE AS dec FROM orders))"""
_SEP = "degrees(2 * asin(sqrt(sin(radians(t.dec - s.dec) / 2) ** 2 + cos(radians(s.dec)) * cos(radians(t.dec)) * sin(radians(t.ra - s.ra) / 2) ** 2)))"


def targets(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), (k * 7919 % 3600 / 10.0).alias("ra"),
                                               (k * 104729 % 1400 / 10.0 - 70).alias("dec"))


def sources(spark, sf):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    ra = k * 7919 % 3600 / 10.0 + (o % 41 - 20) * 0.02 / 3600.0
    return table(spark, sf, "orders").select(
        o.alias("sid"), F.when(ra < 0, ra + 360).otherwise(ra).alias("ra"),
        (k * 104729 % 1400 / 10.0 - 70 + (o % 37 - 18) * 0.02 / 3600.0).alias("dec"))


# Equal target positions collapse to the smallest id, as the nearest target is then a tie.
_MATCH = f"""pairs AS (SELECT sid, t.id, {_SEP} AS sep FROM src s JOIN (SELECT ra, dec, min(id) AS id FROM tgt GROUP BY 1, 2) t
    ON abs(t.dec - s.dec) <= 0.001 AND (abs(t.ra - s.ra) <= 0.01 OR abs(t.ra - s.ra) >= 359.9)
    WHERE {_SEP} <= 0.3::DOUBLE / 3600.0::DOUBLE),
  own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY sep, id) AS rn FROM pairs) WHERE rn = 1),
  near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sep, sid) AS rk, count(*) OVER (PARTITION BY id) AS n_in_radius FROM own),
  matched AS (SELECT tgt.id, sid, sep * 3600 AS sep_arcsec, n_in_radius FROM tgt LEFT JOIN (SELECT * FROM near WHERE rk = 1) n ON tgt.id = n.id)"""


@query("sky_match", f"WITH {_TGT}, {_SRC}, {_MATCH} SELECT id, {r('sep_arcsec')} AS sep_arcsec, n_in_radius::BIGINT AS n_in_radius FROM matched")
def sky_match(spark, sf):
    out = skymatch.sky_match(targets(spark, sf), sources(spark, sf), 0.3, target_id="id", source_id="sid")
    return round_all(out.select("id", "sep_arcsec", "n_in_radius"))


@query("match_report", f"""WITH {_TGT}, {_SRC}, {_MATCH} SELECT count(*) AS n, count(sep_arcsec) AS n_matched,
  {r('100.0 * count(sep_arcsec) / count(*)')} AS pct_matched, {r('median(sep_arcsec)')} AS median_sep FROM matched""")
def match_report(spark, sf):
    out = skymatch.sky_match(targets(spark, sf), sources(spark, sf), 0.3, target_id="id", source_id="sid")
    return round_all(skymatch.match_report(out))


_PROGRESSIVE = f"""WITH {_TGT}, {_SRC}, pairs AS (SELECT t.id, sid, {_SEP} AS sep FROM src s JOIN tgt t
    ON abs(t.dec - s.dec) <= 0.001 AND (abs(t.ra - s.ra) <= 0.01 OR abs(t.ra - s.ra) >= 359.9) WHERE {_SEP} <= 0.5::DOUBLE / 3600.0::DOUBLE),
  near AS (SELECT id FROM pairs WHERE sep <= 0.1::DOUBLE / 3600.0::DOUBLE)
  SELECT id, sid, CASE WHEN id IN (SELECT id FROM near) THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END AS radius_arcsec FROM pairs
  WHERE sep <= 0.1::DOUBLE / 3600.0::DOUBLE OR id NOT IN (SELECT id FROM near)"""


@query("progressive_match", _PROGRESSIVE)
def progressive_match(spark, sf):
    out = skymatch.match_progressively(targets(spark, sf), sources(spark, sf), [0.1, 0.5], target_id="id", source_id="sid")
    return out.select("id", "sid", "radius_arcsec")


@query("zone_index_match", _PROGRESSIVE)
def zone_index_match(spark, sf):
    index = skymatch.build_zone_index(sources(spark, sf), source_id="sid", cell_arcsec=30.0, buckets=16)
    out = skymatch.match_in_zones(targets(spark, sf), index, [0.1, 0.5], target_id="id")
    return out.select("id", "sid", "radius_arcsec")


_CENTRES = """centres(cluster, c_ra, c_dec, radius, c_pmra, c_pmdec, pm_tol) AS (VALUES
  ('M67', 132.846::DOUBLE, 11.814::DOUBLE, 1.0::DOUBLE, -10.97::DOUBLE, -2.94::DOUBLE, 1.0::DOUBLE),
  ('M71', 298.444::DOUBLE, 18.779::DOUBLE, 0.5::DOUBLE, -3.41::DOUBLE, -2.61::DOUBLE, 1.0::DOUBLE),
  ('M107', 248.133::DOUBLE, -13.054::DOUBLE, 0.5::DOUBLE, -1.93::DOUBLE, -5.98::DOUBLE, 1.0::DOUBLE))"""
# Stars scattered over three fields about three times the cone radius wide.
_FIELD = """field AS (SELECT o_orderkey, [132.846, 298.444, 248.133][f + 1]::DOUBLE + (o_orderkey * 7919 % 4001 - 2000) / 1000.0::DOUBLE AS ra,
    [11.814, 18.779, -13.054][f + 1]::DOUBLE + (o_orderkey * 6007 % 3001 - 1500) / 1000.0::DOUBLE AS dec,
    [-10.97, -3.41, -1.93][f + 1]::DOUBLE + (o_orderkey % 23 - 11) / 8.0::DOUBLE AS pmra,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE [-2.94, -2.61, -5.98][f + 1]::DOUBLE + (o_orderkey % 29 - 14) / 8.0::DOUBLE END AS pmdec
  FROM (SELECT o_orderkey, o_custkey % 3 AS f FROM orders)),
  cone AS (SELECT o_orderkey, cluster, pmra, pmdec, c_pmra, c_pmdec, pm_tol FROM field, centres
    WHERE sqrt(((ra - c_ra) * cos(radians(c_dec))) ** 2 + (dec - c_dec) ** 2) < radius),
  moving AS (SELECT * FROM cone WHERE sqrt((pmra - c_pmra) ** 2 + (pmdec - c_pmdec) ** 2) < pm_tol)"""


def field(spark, sf):
    k = F.col("o_orderkey")

    def pick(*v):
        return F.element_at(F.array(*[F.lit(float(a)) for a in v]), (F.col("o_custkey") % 3 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        "o_orderkey", (pick(132.846, 298.444, 248.133) + (k * 7919 % 4001 - 2000) / 1000.0).alias("ra"),
        (pick(11.814, 18.779, -13.054) + (k * 6007 % 3001 - 1500) / 1000.0).alias("dec"),
        (pick(-10.97, -3.41, -1.93) + (k % 23 - 11) / 8.0).alias("pmra"),
        F.when(k % 11 != 0, pick(-2.94, -2.61, -5.98) + (k % 29 - 14) / 8.0).alias("pmdec"))


def centres(spark):
    from skyledger.operators.clusters import CLUSTER_CENTRES
    return spark.createDataFrame(CLUSTER_CENTRES, "cluster string, c_ra double, c_dec double, radius double, "
                                 "c_pmra double, c_pmdec double, pm_tol double")


@query("cone_members", f"WITH {_CENTRES}, {_FIELD} SELECT cluster, o_orderkey FROM cone")
def cone_members(spark, sf):
    return skymatch.cone_members(field(spark, sf), centres(spark), max_radius=1.0).select("cluster", "o_orderkey")


@query("comoving_counts", f"""WITH {_CENTRES}, {_FIELD}, m AS (SELECT cluster, count(*) AS k FROM moving GROUP BY 1)
  SELECT cluster, count(*) AS n_cone, any_value(coalesce(k, 0)) AS n_comoving FROM cone LEFT JOIN m USING (cluster) GROUP BY cluster""")
def comoving_counts(spark, sf):
    from skyledger.operators.clusters import selection_counts
    cone = skymatch.cone_members(field(spark, sf), centres(spark), max_radius=1.0)
    return selection_counts(cone, skymatch.comoving(cone))


_HUB0 = f"hub0 AS (SELECT *, {LINE_ID} AS sdss_id FROM lineitem)"
_COMBINED = f"""{_HUB0},
  a AS (SELECT * FROM (SELECT l_orderkey AS star, l_quantity / 100 AS sep, l_partkey AS src,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, sdss_id) AS rn FROM hub0 WHERE l_suppkey % 2 = 0) WHERE rn = 1),
  b AS (SELECT * FROM (SELECT l_orderkey AS star, l_discount AS dist, l_partkey AS src,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, sdss_id) AS rn FROM hub0 WHERE l_suppkey % 3 = 0) WHERE rn = 1),
  combined AS (SELECT o_orderkey AS star, o_custkey AS src, a.src AS src_wide, b.src AS src_deep, a.sep AS sep_arcsec, b.dist AS ang_dist,
      a.star IS NOT NULL AS in_wide, b.star IS NOT NULL AS in_deep
    FROM orders LEFT JOIN a ON o_orderkey = a.star LEFT JOIN b ON o_orderkey = b.star)"""


def _combined(spark, sf, require):
    li = table(spark, sf, "lineitem").withColumn("row_id", line_id())
    star, src = F.col("l_orderkey").alias("star"), F.col("l_partkey").alias("src")
    wide = li.filter("l_suppkey % 2 = 0").select(star, src, (F.col("l_quantity") / 100).alias("sep_arcsec"),
                                                 F.lit(0.0).alias("ra"), "row_id")
    deep = li.filter("l_suppkey % 3 = 0").select(star, src, F.col("l_discount").alias("ang_dist"),
                                                 F.lit(0.0).alias("ra"), F.col("row_id").alias("deep_row"))
    tgt = table(spark, sf, "orders").select(F.col("o_orderkey").alias("star"), F.col("o_custkey").alias("src"))
    return joins.combine_matches(tgt, {"wide": (wide, "sep_arcsec"), "deep": (deep, "ang_dist")}, "star", ["ra", "dec"],
                                 {"wide": ["row_id"], "deep": ["deep_row"]}, require)


@query("combine_matches", f"WITH {_COMBINED} SELECT star, src, src_wide, src_deep, {r('sep_arcsec')} AS sep_arcsec, {r('ang_dist')} AS ang_dist, in_wide, in_deep FROM combined")
def combine_matches(spark, sf):
    return round_all(_combined(spark, sf, "none").drop("row_id", "deep_row"))


@query("require_any_match", f"WITH {_COMBINED} SELECT star FROM combined WHERE in_wide OR in_deep")
def require_any_match(spark, sf):
    return _combined(spark, sf, "any").select("star")


@query("require_both_matches", f"WITH {_COMBINED} SELECT star FROM combined WHERE in_wide AND in_deep")
def require_both_matches(spark, sf):
    return _combined(spark, sf, "both").select("star")


@query("match_overlap", f"""WITH {_COMBINED}, c AS (SELECT count(*) AS n, count(*) FILTER (in_wide) AS n_wide, count(*) FILTER (in_deep) AS n_deep,
    count(*) FILTER (in_wide AND in_deep) AS n_both, count(*) FILTER (in_wide OR in_deep) AS n_either FROM combined)
  SELECT *, {r('100.0 * n_wide / n')} AS pct_wide, {r('100.0 * n_deep / n')} AS pct_deep, {r('100.0 * n_both / n')} AS pct_both, {r('100.0 * n_either / n')} AS pct_either FROM c""")
def match_overlap(spark, sf):
    return round_all(joins.match_overlap(_combined(spark, sf, "none"), "wide", "deep"))


_MEM = """mem AS (SELECT l_suppkey AS cluster, l_orderkey AS gaia_id, min(l_partkey) AS star FROM lineitem GROUP BY 1, 2),
  probs AS (SELECT l_suppkey AS cluster, l_orderkey AS gaia_id, max(l_quantity) / 50 AS prob FROM lineitem WHERE l_suppkey % 9 <> 0 AND l_orderkey % 4 <> 0 GROUP BY 1, 2)"""


def members(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cluster"), F.col("l_orderkey").alias("gaia_id")).agg(
        F.min("l_partkey").alias("star"))


def member_probs(spark, sf):
    return (table(spark, sf, "lineitem").filter("l_suppkey % 9 <> 0 AND l_orderkey % 4 <> 0")
            .groupBy(F.col("l_suppkey").alias("cluster"), F.col("l_orderkey").alias("gaia_id"))
            .agg((F.max("l_quantity") / 50).alias("prob")))


@query("membership_probability", f"WITH {_MEM} SELECT cluster, gaia_id, star, {r('prob')} AS memberprob FROM mem JOIN probs USING (cluster, gaia_id) WHERE prob >= 0.9")
def membership_probability(spark, sf):
    return round_all(joins.membership_probability(members(spark, sf), member_probs(spark, sf), "cluster", "gaia_id", "prob", 0.9))


@query("uncatalogued_clusters", f"WITH {_MEM} SELECT cluster, count(*) AS n_dropped, true AS no_catalogue FROM mem WHERE cluster NOT IN (SELECT cluster FROM probs) GROUP BY cluster")
def uncatalogued_clusters(spark, sf):
    return joins.uncatalogued(members(spark, sf), member_probs(spark, sf), "cluster")


@query("label_lookup", "SELECT o_orderkey, c_mktsegment AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def label_lookup(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    first = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    second = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("label"))
    return joins.label_lookup(o, "key", "label", first, second, ["key"]).select("o_orderkey", "label")


@query("reuse_results", f"WITH {HUB} SELECT sdss_id, {r('CASE WHEN l_orderkey % 3 = 0 THEN plx_sp / plx END', 9)} AS plx_sp FROM hub")
def reuse_results(spark, sf):
    cat = hub(spark, sf).withColumn("plx_sp", F.col("plx_sp") / F.col("plx"))
    return round_all(joins.reuse_results(cat.select("sdss_id"), cat.filter("l_orderkey % 3 = 0"), "sdss_id", ["plx_sp"]), 9)


@query("attach_column", f"SELECT l_orderkey, l_linenumber, l_partkey, {r('CASE WHEN p_size % 4 <> 0 THEN p_retailprice END')} AS price FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def attach_column(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice")).alias("price"))
    return round_all(joins.attach_column(li, part, "l_partkey", "price", ["l_partkey"]))


# --- set operations and ordering ------------------------------------------------
@query("common_ids", """WITH g AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), h AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus <> 'O')
  SELECT l_suppkey, count(o_orderkey) AS n_matched, count(*) AS n_ids FROM g LEFT JOIN h ON l_orderkey = o_orderkey GROUP BY 1""")
def common_ids(spark, sf):
    have = table(spark, sf, "orders").filter("o_orderstatus <> 'O'")
    return joins.common_ids(table(spark, sf, "lineitem"), "l_suppkey", "l_orderkey", have, "o_orderkey")


@query("top_clusters", """SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 5""")
def top_clusters(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(5)


@query("union_by_name", """SELECT l_orderkey AS id, l_quantity AS q, NULL::VARCHAR AS status FROM lineitem
  UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders""")
def union_by_name(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("q"))
    b = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True)


@query("distinct_pairs", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def distinct_pairs(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()


@query("id_difference", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def id_difference(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").subtract(
        table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")))
