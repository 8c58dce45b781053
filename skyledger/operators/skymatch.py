"""Positional matching as an equi-join on sky cells.

The sky is cut into declination bands of one height; each band has its own number
of RA cells so that cells keep about the same width. A source falls in exactly one
cell. A target is listed in every cell its search circle can touch, per band and
modulo that band's cell count, so poles and RA 0/360 need no special case.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions import sky
from skyledger.functions.exprs import in_range, is_finite
from skyledger.operators.dedup import keep_best, keep_first
from skyledger.operators.quantiles import medians, with_scalars
from skyledger.session import stage, staging_folder

# Sources of one cell that go to one task.
SPLIT_ROWS = 100_000


def _cells_in_band(band: Column, height: float) -> Column:
    middle = F.radians((band + 0.5) * height - 90.0)
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(middle) / height)).cast("long")


def _home_cell(df: DataFrame, ra: str, dec: str, height: float) -> DataFrame:
    band = F.floor((F.col(dec) + 90.0) / height)
    return (df.withColumn("__band", band).withColumn("__ncell", _cells_in_band(F.col("__band"), height))
            .withColumn("__cell", F.pmod(F.floor(F.pmod(F.col(ra), F.lit(360.0)) / 360.0 * F.col("__ncell")),
                                         F.col("__ncell"))).drop("__ncell"))


def _touched_cells(df: DataFrame, ra: str, dec: str, radius: Column, height: float) -> DataFrame:
    r = F.radians(radius) * 1.000001
    d = F.radians(F.abs(F.col(dec)))
    # Largest RA offset on the circle; a circle over a pole touches every RA.
    half = F.when(d + r < F.lit(1.5707963), F.degrees(F.asin(F.sin(r) / F.cos(d)))).otherwise(F.lit(180.0))
    pad = radius * 1.000001
    bands = F.sequence(F.floor((F.col(dec) - pad + 90.0) / height), F.floor((F.col(dec) + pad + 90.0) / height))
    rows = df.withColumn("__half", half).withColumn("__band", F.explode(bands))
    rows = rows.withColumn("__ncell", _cells_in_band(F.col("__band"), height))
    lo = F.floor((F.col(ra) - F.col("__half")) / 360.0 * F.col("__ncell"))
    hi = F.least(F.floor((F.col(ra) + F.col("__half")) / 360.0 * F.col("__ncell")), lo + F.col("__ncell") - 1)
    cells = F.transform(F.sequence(lo, hi), lambda c: F.pmod(c, F.col("__ncell")))
    return rows.withColumn("__cell", F.explode(cells)).drop("__half", "__ncell")


def _salted(sources: DataFrame, targets: DataFrame, spread: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split every cell by the sources it holds; its targets are listed once per split."""
    splits = sources.groupBy("__band", "__cell").agg(F.ceil(F.count(F.lit(1)) / SPLIT_ROWS).alias("__splits"))
    src = sources.join(splits, ["__band", "__cell"]).withColumn(
        "__salt", F.pmod(F.xxhash64(*spread), F.col("__splits"))).drop("__splits")
    # Targets of empty cells match nothing and go here.
    tgt = targets.join(splits, ["__band", "__cell"]).withColumn(
        "__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__splits") - 1))).drop("__splits")
    return src, tgt


def candidate_pairs(sources: DataFrame, targets: DataFrame, radius_deg: float) -> DataFrame:
    """Pairs of distinct positions within the radius: ``s_ra, s_dec, t_ra, t_dec``.

    Equal positions are collapsed first, so a pile-up at one point costs one row.
    """
    height = max(4.0 * radius_deg, 1e-5)
    src = _home_cell(sources.select("s_ra", "s_dec").distinct(), "s_ra", "s_dec", height)
    tgt = _touched_cells(targets.select("t_ra", "t_dec").distinct(), "t_ra", "t_dec",
                         F.lit(float(radius_deg)), height)
    src, tgt = _salted(src, tgt, ["s_ra", "s_dec"])
    pairs = src.join(tgt, ["__band", "__cell", "__salt"])
    sep = sky.separation("s_ra", "s_dec", "t_ra", "t_dec")
    return pairs.select("s_ra", "s_dec", "t_ra", "t_dec", sep.alias("sep_deg")).filter(
        F.col("sep_deg") <= radius_deg)


def sky_match(targets: DataFrame, sources: DataFrame, radius_arcsec: float, *, target_id: str,
              source_id: str, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Nearest source per target, each source going to its nearest target first.

    Returns every target with ``source_id``, ``sep_arcsec`` and ``n_in_radius``
    (null where unmatched). Ties go to the smaller id.
    """
    ok = in_range(ra) & in_range(dec)
    src = (sources.filter(ok).groupBy(F.col(ra).alias("s_ra"), F.col(dec).alias("s_dec"))
           .agg(F.min(source_id).alias("__sid"), F.count(F.lit(1)).alias("__ns")))
    tgt = (targets.filter(ok).groupBy(F.col(ra).alias("t_ra"), F.col(dec).alias("t_dec"))
           .agg(F.min(target_id).alias("__tid")))
    pairs = candidate_pairs(src, tgt, radius_arcsec / 3600.0).join(tgt, ["t_ra", "t_dec"])
    owner = keep_best(pairs.select("s_ra", "s_dec", "__tid", "sep_deg"), ["s_ra", "s_dec"],
                      [F.col("sep_deg"), F.col("__tid")])
    owned = owner.join(src, ["s_ra", "s_dec"])
    nearest = owned.groupBy("__tid").agg(
        F.min_by(F.struct("__sid", "sep_deg"), F.struct("sep_deg", "__sid")).alias("__b"),
        F.sum("__ns").alias("n_in_radius"))
    matched = nearest.select(F.col("__tid").alias(target_id), F.col("__b.__sid").alias(source_id),
                             (F.col("__b.sep_deg") * 3600.0).alias("sep_arcsec"), "n_in_radius")
    return targets.join(matched, target_id, "left")


def match_progressively(targets: DataFrame, sources: DataFrame, radii_arcsec: list[float], *,
                        target_id: str, source_id: str, ra: str = "ra",
                        dec: str = "dec") -> DataFrame:
    """All (target, source) pairs within the first radius that finds any for the target."""
    t = targets.filter(in_range(ra) & in_range(dec)).select(
        F.col(target_id), F.col(ra).alias("t_ra"), F.col(dec).alias("t_dec"))
    s = sources.filter(in_range(ra) & in_range(dec)).select(
        F.col(source_id), F.col(ra).alias("s_ra"), F.col(dec).alias("s_dec"))
    todo, found = t, None
    for radius in radii_arcsec:
        pairs = candidate_pairs(s, todo, radius / 3600.0)
        hit = stage(pairs.join(todo, ["t_ra", "t_dec"]).join(s, ["s_ra", "s_dec"])
                    .select(target_id, source_id, F.lit(float(radius)).alias("radius_arcsec"),
                            (F.col("sep_deg") * 3600.0).alias("sep_arcsec")).distinct())
        found = hit if found is None else found.unionByName(hit)
        todo = todo.join(hit.select(target_id).distinct(), target_id, "left_anti")
    return found


@dataclass(frozen=True)
class ZoneIndex:
    """A catalogue kept by sky cell: a bucketed, sorted table, and the splits of its crowded cells."""

    table: str
    source_id: str
    height: float  # of a cell, in degrees
    splits: DataFrame  # __band, __cell, __splits of the cells that have sources


def build_zone_index(sources: DataFrame, *, source_id: str, cell_arcsec: float, buckets: int, ra: str = "ra",
                     dec: str = "dec") -> ZoneIndex:
    """Lay the catalogue out by cell once, for any number of later matches.

    The cell should be a few times the usual radius, ``buckets`` at least the tasks
    that a match is to have. Rows without a position are left out. A cell of more
    than ``SPLIT_ROWS`` sources is split over several buckets. The table lies in
    the staging folder under a name of its own.
    """
    height = max(cell_arcsec / 3600.0, 1e-5)
    spark = sources.sparkSession
    placed = _home_cell(sources.filter(in_range(ra) & in_range(dec)).select(
        F.col(source_id), F.col(ra).alias("s_ra"), F.col(dec).alias("s_dec")), "s_ra", "s_dec", height)
    splits = stage(placed.groupBy("__band", "__cell").agg(F.ceil(F.count(F.lit(1)) / SPLIT_ROWS).alias("__splits")))
    salted = placed.join(splits, ["__band", "__cell"]).withColumn(
        "__salt", F.pmod(F.xxhash64(source_id, "s_ra", "s_dec"), F.col("__splits"))).drop("__splits")
    name = f"zones_{uuid.uuid4().hex}"
    keys = ["__band", "__cell", "__salt"]
    (salted.repartition(buckets, *keys).write.option("path", f"{staging_folder(spark)}/{name}").format("parquet")
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return ZoneIndex(name, source_id, height, splits)


def zone_pairs(targets: DataFrame, index: ZoneIndex, radius_arcsec: float) -> DataFrame:
    """All pairs of ``targets`` (with ``t_ra, t_dec``) and indexed sources within the radius, with ``sep_deg``.

    Only the targets move: the index is read bucket by bucket as it lies.
    """
    spark = targets.sparkSession
    radius = radius_arcsec / 3600.0
    touched = _touched_cells(targets, "t_ra", "t_dec", F.lit(float(radius)), index.height)
    listed = touched.join(index.splits, ["__band", "__cell"]).withColumn(
        "__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__splits") - 1))).drop("__splits")
    pairs = spark.table(index.table).join(listed, ["__band", "__cell", "__salt"]).drop("__band", "__cell", "__salt")
    return pairs.withColumn("sep_deg", sky.separation("s_ra", "s_dec", "t_ra", "t_dec")).filter(F.col("sep_deg") <= radius)


def match_in_zones(targets: DataFrame, index: ZoneIndex, radii_arcsec: list[float], *, target_id: str, ra: str = "ra",
                   dec: str = "dec") -> DataFrame:
    """As ``match_progressively`` against an indexed catalogue; every radius reads the same index."""
    todo = targets.filter(in_range(ra) & in_range(dec)).select(F.col(target_id), F.col(ra).alias("t_ra"), F.col(dec).alias("t_dec"))
    found = None
    for radius in radii_arcsec:
        hit = stage(zone_pairs(todo, index, radius).select(
            target_id, index.source_id, F.lit(float(radius)).alias("radius_arcsec"),
            (F.col("sep_deg") * 3600.0).alias("sep_arcsec")).distinct())
        found = hit if found is None else found.unionByName(hit)
        todo = todo.join(hit.select(target_id).distinct(), target_id, "left_anti")
    return found


def match_report(matched: DataFrame, sep: str = "sep_arcsec") -> DataFrame:
    """Targets, matches, match rate and median separation in one row."""
    counts = matched.agg(F.count(F.lit(1)).alias("n"), F.count(sep).alias("n_matched"),
                         (100.0 * F.count(sep) / F.count(F.lit(1))).alias("pct_matched"))
    return with_scalars(counts, medians(matched, [], [sep]).withColumnRenamed(sep, "median_sep"))


def cone_members(stars: DataFrame, centres: DataFrame, *, ra: str = "ra", dec: str = "dec",
                 name: str = "cluster", max_radius: float) -> DataFrame:
    """Stars inside each centre's flat-sky cone.

    ``centres`` carries ``c_ra, c_dec, radius`` in degrees; ``max_radius`` bounds
    the radii and sets the cell size.
    """
    height = max(max_radius, 0.01)
    src = _home_cell(stars.filter(in_range(ra) & in_range(dec)), ra, dec, height)
    # Near the pole the flat metric reaches further than the circle does.
    reach = F.least(F.col("radius") * 1.05, F.lit(90.0))
    tgt = _touched_cells(centres, "c_ra", "c_dec", reach, height)
    pairs = src.join(tgt, ["__band", "__cell"]).drop("__band", "__cell")
    return pairs.filter(sky.flat_separation(ra, dec, "c_ra", "c_dec") < F.col("radius"))


def comoving(members: DataFrame, *, pmra: str = "pmra", pmdec: str = "pmdec") -> DataFrame:
    """Cone members whose proper motion is known and within the cluster tolerance."""
    dpm = F.hypot(F.col(pmra) - F.col("c_pmra"), F.col(pmdec) - F.col("c_pmdec"))
    return members.filter(F.coalesce(is_finite(dpm) & (dpm < F.col("pm_tol")), F.lit(False)))


def unique_positions(df: DataFrame, key: str, ra: str, dec: str) -> DataFrame:
    """One located row per id, the first by position."""
    return keep_first(df.filter(in_range(ra) & in_range(dec)).select(key, ra, dec), [key], [ra, dec])
