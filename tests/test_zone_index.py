import numpy as np
import pytest

from skyledger.operators import skymatch


def catalogue(spark, seed, n, id_col):
    rng = np.random.default_rng(seed)
    ra = np.r_[rng.uniform(0, 0.01, n // 3), rng.uniform(359.99, 360, n // 3), rng.uniform(10, 10.01, n - 2 * (n // 3))]
    dec = np.r_[rng.uniform(-0.01, 0.01, n // 3), rng.uniform(-0.01, 0.01, n // 3), rng.uniform(89.98, 90, n - 2 * (n // 3))]
    rows = [(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec))] + [(n, None, 1.0), (n + 1, float("nan"), 2.0), (0, 0.005, 0.0)]
    return spark.createDataFrame(rows, f"{id_col} long, ra double, dec double")


def as_set(df):
    return sorted((r["id"], r["sid"], r["radius_arcsec"], round(r["sep_arcsec"], 9)) for r in df.collect())


@pytest.mark.parametrize("split_rows", [100_000, 7])
def test_the_index_finds_what_the_plain_match_finds(spark, monkeypatch, split_rows):
    monkeypatch.setattr(skymatch, "SPLIT_ROWS", split_rows)
    sources, targets = catalogue(spark, 1, 240, "sid"), catalogue(spark, 2, 90, "id")
    index = skymatch.build_zone_index(sources, source_id="sid", cell_arcsec=20.0, buckets=5)
    radii = [1.5, 6.0, 40.0]
    got = as_set(skymatch.match_in_zones(targets, index, radii, target_id="id"))
    assert got == as_set(skymatch.match_progressively(targets, sources, radii, target_id="id", source_id="sid")) and len(got) > 50


def test_the_catalogue_is_not_shuffled(spark):
    sources, targets = catalogue(spark, 1, 100, "sid"), catalogue(spark, 2, 50, "id")
    index = skymatch.build_zone_index(sources, source_id="sid", cell_arcsec=20.0, buckets=6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = targets.na.drop().withColumnsRenamed({"ra": "t_ra", "dec": "t_dec"})
        plan = skymatch.zone_pairs(t, index, 2.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "Bucketed: true" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    join = max(i for i in range(scan) if "SortMergeJoin" in lines[i] and depth(lines[i]) < depth(lines[scan]))
    assert not any("Exchange" in line for line in lines[join:scan])


def test_an_empty_catalogue(spark):
    index = skymatch.build_zone_index(catalogue(spark, 1, 30, "sid").limit(0), source_id="sid", cell_arcsec=20.0, buckets=3)
    assert skymatch.match_in_zones(catalogue(spark, 2, 9, "id"), index, [5.0], target_id="id").collect() == []
