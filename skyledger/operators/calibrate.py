"""Error recalibration and prediction-indexed de-biasing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from skyledger.functions import exprs as x
from skyledger.operators import widths
from skyledger.operators.evaluate import (NOTEBOOK_MIN_BIN_ROWS, calibration_bins, clean_catalog,
                                          z_report)
from skyledger.operators.quantiles import medians, on_groups
from skyledger.operators.robust import MAD_SCALE, quantile_bins, robust_stats
from skyledger.session import stage

# The bracket in which the error factor is sought.
FACTOR_MIN, FACTOR_MAX = 1e-3, 100.0
# Factors of a pass; digits to a power of two, as bits, in the first pass, and bits more in each later one.
GRID = 24
FIRST_BITS, MORE_BITS = 5, 4
# Rows of a group that one task solves, and how far candidates reach beyond the bounds of the deviation.
FEW_ROWS = 100_000
REACH = 1e-3


def recalibration_factor(cat: DataFrame, by: Sequence[str], offset: float = 0.0,
                         target: float = 1.0) -> dict[tuple, float]:
    """Per group the factor c that makes the robust chi width equal ``target``.

    The width falls as c grows, so the root is bracketed: counts of the rows by digit,
    at a grid of factors, bound the width at each, and a second, finer grid narrows
    the bracket to a few per cent. Rows that keep their side of the median and of
    the wanted deviation over the whole bracket are then only counted (``widths``),
    and the rest is narrowed again, until what is left of a group, a few thousand
    rows of a large one, is solved in one task. Only brackets and factors of
    folds or configurations reach the driver. A group whose width is above or
    below the target at any factor has the largest or the least one.
    """
    by = list(by)
    spark = cat.sparkSession
    rows = stage(clean_catalog(cat).select(
        *by, (F.col("plx_sp") - (F.col("plx") + F.lit(float(offset)))).alias("resid"),
        "e_plx", "err_sp").filter(
            F.col("resid").isNotNull() & F.col("e_plx").isNotNull() & (F.col("err_sp") > 0)))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()
    groups = [tuple(row[c] for c in by) for row in sizes if row["n"]]
    if not groups:
        return {}
    table = spark.createDataFrame([(*g, i) for i, g in enumerate(groups)], _schema(rows, by).add("group", IntegerType()))
    left = (on_groups(rows, table, by) if by else rows.withColumn("group", F.lit(0))).select("group", "resid", "e_plx", "err_sp")
    known = dict(enumerate(widths.Known(row["n"], FACTOR_MIN, FACTOR_MAX) for row in sizes if row["n"]))
    count, deviation = {g: k.n for g, k in known.items()}, target / MAD_SCALE
    bits, reach = FIRST_BITS, REACH
    while max(count.values()) > FEW_ROWS:
        for _ in range(2):
            known, medians_ = _narrowed(left, known, deviation, bits)
            bits = min(bits + MORE_BITS, 52)
        left, known, fewer = _candidates(left, known, medians_, deviation, REACH)
        if max(fewer.values()) >= max(count.values()) and bits == 52:
            break  # rows alike: they are counted, but cannot be told apart any further
        count = fewer
    out = _solved(left, known, deviation)
    while unsure := [g for g, c in out.items() if c is None]:
        # The two middle deviations lie apart: look at more rows of these groups.
        reach *= 8
        whole = on_groups(rows, table, by) if by else rows.withColumn("group", F.lit(0))
        whole = whole.where(F.col("group").isin(unsure)).select("group", "resid", "e_plx", "err_sp")
        fresh = {g: widths.Known(known[g].n, known[g].c_lo, known[g].c_hi) for g in unsure}
        fresh, medians_ = _narrowed(whole, fresh, deviation, FIRST_BITS)
        more, fresh, _ = _candidates(whole, fresh, medians_, deviation, reach)
        out |= _solved(more, fresh, deviation)
    return {groups[g]: c for g, c in out.items()}


def _narrowed(rows: DataFrame, known: dict, deviation: float, bits: int):
    """Smaller brackets from one pass over a grid of factors, and the medians' bounds at their ends."""
    grids = {g: np.geomspace(k.c_lo, k.c_hi, GRID) for g, k in known.items()}
    for g, k in known.items():
        grids[g][[0, -1]] = k.c_lo, k.c_hi

    def count(batches):
        found: dict[tuple[int, int], list] = {}
        for g, columns in _by_group(batches):
            for k, c in enumerate(grids[g]):
                digits = widths.image(widths.chi(*columns, c)) >> (52 - bits)
                own = found.setdefault((g, k), [])
                own.append(np.unique(digits, return_counts=True))
                if len(own) == 64:
                    found[g, k] = [_added(own)]
        for (g, k), own in found.items():
            digits, n = _added(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), g, np.int32)), pa.array(np.full(len(n), k, np.int32)),
                                              pa.array(digits), pa.array(n)], names=["group", "k", "digit", "n"])

    def bound(key, part):
        import pandas as pd

        g, k = int(key[0]), int(key[1])
        return pd.DataFrame([(g, k, *widths.bounds(part["digit"].to_numpy(), part["n"].to_numpy(), bits, known[g]))])

    counts = rows.mapInArrow(count, "group int, k int, digit long, n long").groupBy("group", "k", "digit").agg(F.sum("n").alias("n"))
    at: dict[int, dict[int, tuple]] = {}
    for row in counts.groupBy("group", "k").applyInPandas(
            bound, "group int, k int, m_lo double, m_hi double, least double, most double").collect():
        at.setdefault(row["group"], {})[row["k"]] = tuple(row)[2:]
    out, medians_ = {}, {}
    for g, k in known.items():
        if g not in at:
            out[g], medians_[g] = k, (0.0, 0.0, 0.0, np.inf)
            continue
        above = [i for i in range(GRID) if at[g][i][2] > deviation]
        lo = max(above, default=0)
        hi = min((i for i in range(GRID) if i > lo and at[g][i][3] <= deviation), default=GRID - 1)
        if lo == hi:
            lo = hi - 1
        out[g] = replace(k, c_lo=float(grids[g][lo]), c_hi=float(grids[g][hi]))
        ends = at[g][lo], at[g][hi]
        medians_[g] = (min(e[0] for e in ends), max(e[1] for e in ends), min(e[2] for e in ends), max(e[3] for e in ends))
    return out, medians_


def _candidates(rows: DataFrame, known: dict, medians_: dict, deviation: float, reach: float):
    """The rows that the brackets do not settle, written once, with the counts of the others."""
    # Never wider than before: rows left out earlier keep their side only within the earlier limits.
    limits = {g: (m_lo, m_hi, max(known[g].least, min(least, deviation) / (1 + reach)), min(known[g].most, max(most, deviation) * (1 + reach)))
              for g, (m_lo, m_hi, least, most) in medians_.items()}

    def sift(batches):
        totals: dict[int, list[int]] = {}
        for g, columns in _by_group(batches):
            keep, below, inside = widths.candidates(*columns, known[g].c_lo, known[g].c_hi, *limits[g])
            own = totals.setdefault(g, [0, 0, 0])
            for i, v in enumerate((below, inside, int(keep.sum()))):
                own[i] += v
            n = int(keep.sum())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g, np.int32)), *[pa.array(c[keep]) for c in columns],
                                                  *[pa.nulls(n, pa.int64())] * 3], names=names)
        for g, own in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), *[pa.nulls(1, pa.float64())] * 3,
                                              *[pa.array([v], pa.int64()) for v in own]], names=names)

    names = ["group", "resid", "e_plx", "err_sp", "below", "inside", "kept"]
    sifted = stage(rows.mapInArrow(sift, "group int, resid double, e_plx double, err_sp double, below long, inside long, kept long"))
    out, count = dict(known), dict.fromkeys(known, 0)
    for row in sifted.where(F.col("kept").isNotNull()).groupBy("group").agg(
            *[F.sum(c).alias(c) for c in ("below", "inside", "kept")]).collect():
        k, (_, _, least, most) = known[row["group"]], limits[row["group"]]
        out[row["group"]] = replace(k, below=k.below + row["below"], inside=k.inside + row["inside"], least=least, most=most)
        count[row["group"]] = row["kept"]
    return sifted.where(F.col("kept").isNull()).select(*names[:4]), out, count


def _solved(rows: DataFrame, known: dict, deviation: float) -> dict[int, float | None]:
    def solve(key, part):
        import pandas as pd

        g = int(key[0])
        c = widths.solve(*(part[c].to_numpy() for c in columns), known[g], deviation)
        return pd.DataFrame({"group": [g], "factor": [c]})

    columns = ["resid", "e_plx", "err_sp", "n"]
    # Equal rows, which no narrowing can part, stand as one.
    distinct = rows.groupBy("group", *columns[:3]).agg(F.count(F.lit(1)).alias("n"))
    return {row["group"]: row["factor"] for row in distinct.groupBy("group").applyInPandas(solve, "group int, factor double").collect()}


def _by_group(batches):
    """The rows of each group of a batch as (group, [resid, err, scale])."""
    for batch in batches:
        group = batch.column("group").to_numpy()
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("resid", "e_plx", "err_sp")]
        for g in np.unique(group):
            mine = group == g
            yield int(g), [c[mine] for c in columns]


def _added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    digits, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return digits, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _schema(df: DataFrame, by: Sequence[str]):
    return StructType([df.schema[c] for c in by])


def factors_table(cat: DataFrame, by: Sequence[str], factors: dict[tuple, float]) -> DataFrame:
    return cat.sparkSession.createDataFrame([(*g, c) for g, c in factors.items()],
                                            schema=_schema(cat, list(by)).add("factor", DoubleType()))


def calibrate(cat: DataFrame, by: Sequence[str], offset: float = 0.0, nbins: int = 8) -> DataFrame:
    """Calibration bins with the error factor of the same selection."""
    bins = calibration_bins(cat, by, offset=offset, nbins=nbins)
    factors = recalibration_factor(cat, by, offset)
    if not by:
        return bins.withColumn("factor", F.lit(factors[()]))
    return bins.join(factors_table(cat, by, factors), list(by))


def bias_knots(cat: DataFrame, nbins: int = 12, snr: float = 20.0) -> list[tuple[float, float]]:
    """Median residual against the prediction in quantile bins, as interpolation knots."""
    rows = (clean_catalog(cat).filter(x.hi_snr("plx", "e_plx", snr))
            .select("plx_sp", x.fractional_residual("plx_sp", "plx").alias("frac")))
    binned = quantile_bins(rows, [], "plx_sp", nbins)
    med = medians(binned, ["bin"], ["plx_sp", "frac"])
    n = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    kept = on_groups(med, n, ["bin"]).filter(F.col("n") >= NOTEBOOK_MIN_BIN_ROWS)
    return [(r["plx_sp"], r["frac"]) for r in kept.orderBy("bin").collect()]


def interpolate(value: str | Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear interpolation with flat ends, as one CASE expression."""
    v = x.col(value)
    out = F.when(v <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots[:-1], knots[1:]):
        out = out.when(v <= x1, y0 + (v - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0))
    return out.when(v.isNotNull(), F.lit(knots[-1][1]))


def debias(cat: DataFrame, knots: Sequence[tuple[float, float]]) -> DataFrame:
    """Divide the bias, read off at the prediction, out of the prediction."""
    return cat.withColumn("plx_sp", F.col("plx_sp") / (1.0 + interpolate("plx_sp", knots)))


def debias_report(cat: DataFrame, fit_fold: str = "A", apply_fold: str = "B", nbins: int = 12,
                  snr: float = 20.0) -> DataFrame:
    """Bias and scatter on one fold before and after a correction fitted on the other."""
    knots = bias_knots(cat.filter(F.col("sample") == fit_fold), nbins, snr)
    held = clean_catalog(cat.filter(F.col("sample") == apply_fold)).filter(
        x.hi_snr("plx", "e_plx", snr))
    after = debias(held, knots)
    frac = x.fractional_residual("plx_sp", "plx")
    rows = held.select(F.lit("before").alias("stage"), frac.alias("frac")).unionByName(
        after.select(F.lit("after").alias("stage"), frac.alias("frac")))
    out = robust_stats(rows, ["stage"], ["frac"])
    return out.select("stage", F.col("frac_n").alias("n"), F.col("frac_med").alias("bias"),
                      F.col("frac_scatter").alias("scatter"))


def probe_stages(cat: DataFrame, fit_fold: str = "A", apply_fold: str = "B", snr: float = 20.0) -> tuple[float, DataFrame]:
    """Error factor from one fold's probe, and the other fold's rows before and after it as ``stage``."""
    clean = clean_catalog(cat)
    fit = clean.filter((F.col("sample") == fit_fold) & x.hi_snr("plx", "e_plx", snr))
    factor = recalibration_factor(fit, [])[()]
    held = clean.filter(F.col("sample") == apply_fold)
    return factor, held.withColumn("stage", F.lit("before")).unionByName(
        held.withColumn("stage", F.lit("after")).withColumn("err_sp", F.col("err_sp") * factor))


def probe_table(both: DataFrame, axis: Column, nbins: int = 8, snr: float = 20.0) -> DataFrame:
    """The calibration table by ``axis`` of both stages; the probe is written once, as for ``probe_width``."""
    probe = both.filter(x.hi_snr("plx", "e_plx", snr)).select("stage", "plx", "e_plx", "plx_sp", "err_sp", axis.alias("__axis"))
    return calibration_bins(stage(probe), ["stage"], axis=F.col("__axis"), nbins=nbins, snr=snr, min_rows=NOTEBOOK_MIN_BIN_ROWS)


def probe_width(both: DataFrame, snr: float = 20.0) -> DataFrame:
    """The probe's z width at both stages; its rows are written once, narrow, as every pass reads them again."""
    probe = both.filter(x.hi_snr("plx", "e_plx", snr)).select("stage", "plx", "e_plx", "plx_sp", "err_sp")
    return z_report(stage(probe), ["stage"])


def probe_recalibration(cat: DataFrame, axis: Column, fit_fold: str = "A", apply_fold: str = "B",
                        nbins: int = 8, snr: float = 20.0) -> tuple[float, DataFrame, DataFrame]:
    """Error factor from one fold's probe, applied to the other.

    Returns the factor, the calibration table by ``axis`` and the probe's z width,
    both before and after. Each costs passes of its own: ``probe_table`` and
    ``probe_width`` give one alone.
    """
    factor, both = probe_stages(cat, fit_fold, apply_fold, snr)
    return factor, probe_table(both, axis, nbins, snr), probe_width(both, snr)


def constant_error(cat: DataFrame, snr: float = 20.0) -> DataFrame:
    """Quoted error as one fraction of the prediction, from the training probe.

    The fraction is the robust scatter of ln(prediction) - ln(parallax).
    """
    clean = clean_catalog(cat)
    probe = clean.filter(F.col("train") & (F.col("plx") > 0) & x.hi_snr("plx", "e_plx", snr))
    rows = probe.select((F.ln("plx_sp") - F.ln("plx")).alias("lnr"))
    frac = robust_stats(rows, [], ["lnr"]).first()["lnr_scatter"]
    return cat.withColumn("frac_sigma", F.lit(frac)).withColumn("err_sp", F.col("plx_sp") * F.lit(frac))
