"""Edge rows: missing values, ties, repeated ids, small bins, the RA wrap."""

import math

import pytest
from pyspark.sql import functions as F

from skyledger.operators import clusters as cl, dedup, evaluate as ev, joins, selection as sel, skymatch
from skyledger.functions import exprs as x

NAN, INF = float("nan"), float("inf")


def catalog(spark, rows):
    return spark.createDataFrame(rows, "sdss_id long, plx double, e_plx double, plx_sp double, err_sp double, sample string")


def test_nan_and_null_never_pass_a_cut(spark):
    df = spark.createDataFrame([(NAN,), (None,), (INF,), (-INF,), (120.0,)], "v double")
    assert df.filter(x.holds(x.finite("v") > 100)).count() == 1
    assert df.filter(x.is_finite("v")).count() == 1


def test_probe_handles_zero_error_and_negative_parallax(spark):
    df = catalog(spark, [(1, 1.0, 0.0, 1.0, 0.1, "A"), (2, -1.0, 0.01, 1.0, 0.1, "A"), (3, 1.0, 0.05, 1.0, 0.1, "A"),
                         (4, 1.0, NAN, 1.0, 0.1, "A")])
    got = [r[0] for r in ev.clean_catalog(df).filter(x.hi_snr("plx", "e_plx")).select("sdss_id").collect()]
    assert got == [3]


def test_bins_under_twenty_rows_are_left_out(spark):
    rows = [(i, 1.0, 0.01, 1.0 + 0.001 * i, 0.1 + 0.001 * (i % 7), "A") for i in range(60)]
    out = ev.bias_bins(catalog(spark, rows), nbins=8)
    assert out.count() == 0
    assert ev.bias_bins(catalog(spark, rows), nbins=2).count() == 2


def test_residual_sign_is_spec_minus_catalog(spark):
    df = catalog(spark, [(1, 1.0, 0.01, 1.2, 0.1, "A")])
    assert df.select(x.fractional_residual("plx_sp", "plx", 0.05)).first()[0] == pytest.approx(0.15)


def test_ties_and_missing_snr_pick_the_same_row_in_any_order(spark):
    rows = [(1, 10, 5.0), (1, 11, 5.0), (1, 12, NAN), (2, 20, None), (2, 21, 1.0)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "star long, row long, snr double").repartition(parts)
        got = {r["star"]: r["row"] for r in dedup.keep_highest(df, ["star"], "snr", ["row"]).collect()}
        assert got == {1: 10, 2: 21}


def test_most_complete_row_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1, 1, NAN, 2.0), (1, 2, 1.0, 2.0), (1, 3, 1.0, 2.0)], "star long, row long, a double, b double")
    assert dedup.keep_most_complete(df, ["star"], ["a", "b"], ["row"]).first()["row"] == 2


def test_ids_beyond_double_precision_stay_exact(spark):
    big = 9007199254740993  # 2^53 + 1
    cat = spark.createDataFrame([(1,), (2,), (3,)], "sdss_id long")
    xref = spark.createDataFrame([(1, big), (2, big + 1), (3, 0)], "sdss_id long, src long")
    got = {r["sdss_id"]: r["gaia_id"] for r in joins.crosswalk(cat, xref, "sdss_id", "sdss_id", "src", "gaia_id", ["src"]).collect()}
    assert got == {1: big, 2: big + 1, 3: None}


def test_inner_2m_is_removed_and_null_ids_do_not_match(spark):
    cat = spark.createDataFrame([(1, " 2M01-2m5 "), (2, None)], "row long, cid string")
    mem = spark.createDataFrame([("c", "01-5"), ("c", None)], "cluster string, mid string")
    got = joins.match_members(cat, mem, "cid", "mid", "cluster", "row", normalise=True).collect()
    assert [(r["cluster"], r["row"]) for r in got] == [("c", 1)]


def test_member_of_two_clusters_keeps_each_probability(spark):
    mem = spark.createDataFrame([("a", 7, 1), ("b", 7, 1), ("none", 8, 2)], "cluster string, gaia long, star long")
    probs = spark.createDataFrame([("a", 7, 0.95), ("b", 7, 0.99), ("a", 8, 1.0)], "cluster string, gaia long, prob double")
    got = {r["cluster"]: r["memberprob"] for r in joins.membership_probability(mem, probs, "cluster", "gaia", "prob", 0.9).collect()}
    assert got == {"a": 0.95, "b": 0.99}
    assert [r["cluster"] for r in joins.uncatalogued(mem, probs, "cluster").collect()] == ["none"]


def test_aux_flag_needs_every_band(spark):
    df = spark.createDataFrame([(1, 10.0, 11.0), (2, 10.0, 11.0)], "star long, j double, h double")
    aux = spark.createDataFrame([(1, 5.0, 6.0), (2, 5.0, NAN)], "star long, vj double, vh double")
    got = {r["star"]: (r["j"], r["h"], r["survey_ind"]) for r in joins.override_bands(
        df, aux, "star", {"j": "vj", "h": "vh"}, ["vj"]).collect()}
    assert got == {1: (5.0, 6.0, 1.0), 2: (5.0, 11.0, 0.0)}


def test_training_override_keeps_the_guards(spark):
    df = spark.createDataFrame([(1.0, 0.1, 1.0), (None, 0.1, 1.0), (1.0, 0.1, NAN), (1.0, 0.0, 1.0)],
                               "plx double, e_plx double, given double")
    assert [r[0] for r in df.select(sel.training_flag(override="given")).collect()] == [True, False, False, False]


def test_zero_point_falls_back_only_when_none_is_known(spark):
    rows = [(1.0, None), (2.0, NAN)]
    df = spark.createDataFrame(rows, "plx_raw double, zeropoint double")
    assert [r["plx"] for r in sel.apply_zero_point(df).collect()] == [1.0, 2.0]
    df = spark.createDataFrame([*rows, (3.0, -0.5)], "plx_raw double, zeropoint double")
    assert [r["plx"] for r in sel.apply_zero_point(df).collect()] == [None, None, 3.5]


def test_small_clusters_are_skipped_by_matched_rows(spark):
    rows = [("big 1", 1.0 + 0.01 * i, 0.05, 1.0, 0.02) for i in range(5)] + [("tiny", 1.0, 0.1, 1.0, 0.1)] * 4
    rows += [("holes", NAN, 0.1, 1.0, 0.1)] * 3 + [("holes", 1.0, 0.1, 1.0, 0.1)] * 2
    df = spark.createDataFrame(rows, "cluster string, plx_sp double, err_sp double, plx double, e_plx double")
    got = {r["cluster"]: r for r in cl.cluster_test(df, reference={"BIG1": 1.0}).collect()}
    assert set(got) == {"big 1", "holes"}
    assert got["holes"]["n_matched"] == 5 and got["holes"]["n"] == 2
    assert got["big 1"]["sp_vs_lit_fracdiff"] == pytest.approx(0.02)
    assert got["holes"]["lit_plx"] is None


def brute(targets, sources, radius):
    """Nearest target per source, then nearest source and count per target."""
    def sep(a, b):
        d1, d2 = math.radians(a[2]), math.radians(b[2])
        h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return math.degrees(2 * math.asin(math.sqrt(h))) * 3600
    owned = {}
    for s in sources:
        best = min(((sep(s, t), t[0]) for t in targets), default=None)
        if best and best[0] <= radius:
            owned.setdefault(best[1], []).append((best[0], s[0]))
    return {t: (min(v)[1], len(v)) for t, v in owned.items()}


@pytest.mark.parametrize("limit", [5, 100_000])
def test_sky_match_near_poles_and_across_zero(spark, limit, monkeypatch):
    monkeypatch.setattr(skymatch, "SPLIT_ROWS", limit)
    import random
    rnd = random.Random(4)
    targets, sources = [], []
    for i, (ra, dec) in enumerate([(0.0005, 10.0), (359.9995, 10.0), (120.0, 89.9995), (300.0, 89.9992),
                                   (10.0, -89.9998), (50.0, 0.0), (50.0004, 0.0003)]):
        targets.append((i, ra, dec))
        for _ in range(30):
            d = min(90.0, max(-90.0, dec + rnd.uniform(-0.002, 0.002)))
            spread = 0.002 / max(math.cos(math.radians(dec)), 1e-5)
            sources.append((len(sources), (ra + rnd.uniform(-spread, spread)) % 360, d))
    t = spark.createDataFrame(targets, "tid long, ra double, dec double")
    s = spark.createDataFrame(sources, "sid long, ra double, dec double")
    got = {r["tid"]: (r["sid"], r["n_in_radius"]) for r in skymatch.sky_match(
        t, s, 3.0, target_id="tid", source_id="sid").collect() if r["sid"] is not None}
    assert got == brute(targets, sources, 3.0)


def test_piled_up_positions_cost_one_pair(spark):
    s = spark.range(2000).select(F.col("id").alias("sid"), F.lit(10.0).alias("s_ra"), F.lit(5.0).alias("s_dec"))
    t = spark.createDataFrame([(1, 10.0, 5.0)], "tid long, t_ra double, t_dec double")
    assert skymatch.candidate_pairs(s, t, 0.001).count() == 1
    out = skymatch.sky_match(t.toDF("tid", "ra", "dec"), s.toDF("sid", "ra", "dec"), 1.0, target_id="tid", source_id="sid").first()
    assert (out["sid"], out["n_in_radius"], out["sep_arcsec"]) == (0, 2000, 0.0)


def test_repeated_catalogue_ids_do_not_multiply_members(spark):
    from skyledger.operators import clusters, joins
    members = spark.createDataFrame([("c", 1, 10), ("c", 1, 11), ("c", 2, 12)], "cluster string, sdss_id long, gaia_dr3_source_id long")
    probs = spark.createDataFrame([("c", 10, 0.91), ("c", 10, 0.95), ("c", 11, 0.99), ("c", 12, 0.5)],
                                  "cluster string, gaia_dr3_source_id long, prob double")
    kept = joins.membership_probability(members, probs, "cluster", "gaia_dr3_source_id", "prob", 0.9)
    assert sorted((r["gaia_dr3_source_id"], r["memberprob"]) for r in kept.collect()) == [(10, 0.95), (11, 0.99)]
    spectra = spark.createDataFrame([(1, 50.0, 0, 7), (2, 60.0, 0, 8)], "sdss_id long, snr double, spectrum_flags long, visit long")
    got = clusters.prepare_member_spectra(members, spectra, probs=probs, row_id=["visit"]).collect()
    assert [(r["sdss_id"], r["memberprob"]) for r in got] == [(1, 0.99)]


def test_cones_reach_across_zero(spark):
    stars = spark.createDataFrame([(1, 359.9, 10.0), (2, 0.2, 10.0), (3, 1.2, 10.0)], "id long, ra double, dec double")
    centres = spark.createDataFrame([("c", 0.05, 10.0, 0.5)], "cluster string, c_ra double, c_dec double, radius double")
    assert sorted(r["id"] for r in skymatch.cone_members(stars, centres, max_radius=0.5).collect()) == [1, 2]


def test_line_ids_stay_unique_for_large_keys(spark):
    from skyledger.plans.tables import line_id
    rows = [(o, n, p, s, 1.0) for o in (1, 600_000_000) for n in (1, 7) for p in (1, 100_001, 20_000_000) for s in (1, 10_001, 1_000_000)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    assert df.select(line_id().alias("i")).distinct().count() == len(rows)
