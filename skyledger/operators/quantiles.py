"""Exact grouped quantiles and deviations by radix selection.

One algorithm at every size. Each value falls into one of a few hundred digits that
keep its order (sign, power of two, sixteenth of it), counted by group with the
least and greatest value of each digit. The counts tell in which digits the wanted
ranks lie, and, as a deviation's bounds follow from those of the value and of the
centre, where the median deviation can lie. Only rows in those digits are counted
again: by value once they are few, else by a finer digit first. So a pass narrows
by orders of magnitude; two do for most tables, three or four for any.

Rows are never shuffled and never multiplied into ranks; counts are, combined on
the map side. A cell (one value in one group) is a bounded list of counts however
many rows the group has. Each pass is written once, which cuts the lineage.

Missing values (null, NaN, infinite) are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import StructType

from skyledger.functions.exprs import finite
from skyledger.operators import cells
from skyledger.session import stage

# Digits to a power of two in the first pass, and parts of an open stretch in later ones.
PER_OCTAVE = 16
PARTS = 4096
# Rows of one cell that are counted by value; a cell with more of them takes a finer digit first.
FEW_ROWS = 200_000

_BUCKETS = "array<struct<lo: double, hi: double, n: long, open: boolean>>"
_STRETCHES = "array<struct<lo: double, hi: double>>"
_CELL = (f"__total long, __open long, __buckets {_BUCKETS}, __stretches {_STRETCHES}, __found array<double>, __before long")


def on_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-group table back on its group columns, null groups included.

    Catalyst picks the join by size and AQE splits skewed groups.
    """
    if not by:
        return with_scalars(left, right)
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in by else F.col(c)
                             for c in right.columns])
    cond = F.lit(True)
    for i, c in enumerate(by):
        match = left[c].eqNullSafe(renamed[f"__{c}"])
        cond = match if i == 0 else cond & match
    return left.join(renamed, cond, how).drop(*[f"__{c}" for c in by])


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row table; they are nulls if it has no row."""
    row = one_row.select(F.struct(*one_row.columns).alias("r")).scalar()
    return df.withColumn("__one", row).select("*", *[F.col(f"__one.{c}").alias(c) for c in one_row.columns]).drop("__one")


def exact_quantiles(df: DataFrame, by: Sequence[str], values: Sequence[str],
                    probs: Sequence[float], all_groups: bool = True) -> DataFrame:
    """One row per group; each value column becomes its array of quantiles.

    Quantiles interpolate linearly between neighbours. A group without any value
    has nulls, or no row if ``all_groups`` is off.
    """
    by, values, probs = list(by), list(values), [float(p) for p in probs]
    done = _cells(df, by, values, probs=probs)
    wide = _wide(done, by, {v: (v, F.col("__found")) for v in values})
    if all_groups:
        return wide
    known = [F.col(v).isNotNull().cast("int") for v in values]
    return wide.where(sum(known[1:], known[0]) > 0)


def medians(df: DataFrame, by: Sequence[str], values: Sequence[str], all_groups: bool = True) -> DataFrame:
    out = exact_quantiles(df, by, values, [0.5], all_groups)
    return out.select(*by, *[F.col(v)[0].alias(v) for v in values])


def median_deviations(df: DataFrame, by: Sequence[str], values: Sequence[str],
                      total: tuple[str, str] | None = None) -> DataFrame:
    """Per group and value ``<v>_n`` values, their median ``<v>_med`` and median absolute deviation ``<v>_mad``.

    ``total`` names a column of ``by`` and a label under which all its rows count once
    more; rows where the column is null count under the label only. The label's
    counts are sums of the others', no row is read or counted twice.
    """
    by, values = list(by), list(values)
    done = _cells(df, by, values, probs=[0.5], spread=True, total=total)
    out = {}
    for v in values:
        out[f"{v}_n"] = (v, F.col("__total"))
        out[f"{v}_med"] = (v, F.col("__found")[0])
        out[f"{v}_mad"] = (v, F.col("__found")[1])
    wide = _wide(done, by, out)
    return wide.withColumns({f"{v}_n": F.coalesce(f"{v}_n", F.lit(0).cast("long")) for v in values})


def select_rank(df: DataFrame, by: Sequence[str], value: str, rank: Callable[[int], int]) -> DataFrame:
    """Per group the value at a 0-based rank, ``rank`` being a function of the count.

    Returns ``value``, the number of rows ``before`` that value, and ``total``.
    """
    done = _cells(df, list(by), [value], ranks=lambda n: [min(rank(n), n - 1)]).where(F.col("__total") > 0)
    return done.select(*by, F.col("__found")[0].alias("value"), F.col("__before").alias("before"), F.col("__total").alias("total"))


def _wide(done: DataFrame, by: list[str], columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per group from one per group and value; without groups always one row."""
    return done.groupBy(*by).agg(*[F.first(F.when(F.col("__metric") == v, c), ignorenulls=True).alias(name)
                                   for name, (v, c) in columns.items()])


def _digit(x: Column) -> Column:
    """A whole number that never falls as x grows."""
    size = F.floor(F.ln(F.abs(x)) * (PER_OCTAVE / math.log(2.0))) + 1100 * PER_OCTAVE
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("long"))


def _counted(rows: DataFrame, keys: list[str], digit: Column) -> DataFrame:
    return rows.groupBy(*keys, digit.alias("__digit")).agg(
        F.min("__x").alias("lo"), F.max("__x").alias("hi"), F.count("__x").alias("n"))


def _cells(df: DataFrame, by: list[str], values: list[str], total: tuple[str, str] | None = None, **asked) -> DataFrame:
    """Every (group, value) with what was asked for in ``__found``; groups without values have an empty cell."""
    keys = [*by, "__metric"]
    long = df.select(*by, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(by, values, "__metric", "__x")
    # Guarded only here: a guard names its value twice, which doubles the work of whatever it is put around.
    long = long.withColumn("__x", finite("__x"))
    # The digit of a missing value is null: its group still has a cell.
    first = _counted(long, keys, F.when(F.col("__x").isNotNull(), _digit(F.col("__x"))))
    if total is not None:
        column, label = total
        own = F.when(F.col(column).isNotNull(), F.array(F.lit(label), F.col(column)))
        first = first.withColumn(column, F.explode(F.coalesce(own, F.array(F.lit(label))))).groupBy(*keys, "__digit").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    bucket = F.when(F.col("n") > 0, F.struct("lo", "hi", "n"))
    found, left = _settled(first.groupBy(*keys).agg(F.collect_list(bucket).alias("__counts")), keys, asked)
    done, few = [found], False
    while left:
        few = few or left <= FEW_ROWS
        active = found.where(F.col("__open") > 0).drop("__found", "__before")
        hits = _open_rows(long, keys, active, total)
        digit = F.col("__x") if few else F.floor(
            F.try_divide(F.col("__x") / 2 - F.col("__lo") / 2, F.col("__hi") / 2 - F.col("__lo") / 2) * PARTS)
        finer = _counted(hits, [*keys, "__lo", "__hi"], digit).groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "n")).alias("__finer"))
        known = F.transform(F.filter("__buckets", lambda b: ~b["open"]), lambda b: F.struct(b["lo"], b["hi"], b["n"]))
        counts = on_groups(active, finer, keys).select(*keys, F.concat(known, "__finer").alias("__counts"))
        found, still = _settled(counts, keys, asked)
        # A stretch too short for its digits to divide is counted by value.
        few, left = still >= left, still
        done.append(found)
    whole = done[0].where(F.col("__open") == 0)
    for part in done[1:]:
        whole = whole.unionByName(part.where(F.col("__open") == 0))
    return whole


def _open_rows(long: DataFrame, keys: list[str], active: DataFrame, total: tuple[str, str] | None) -> DataFrame:
    """The values in an open stretch of their own group's cell, or of the total's.

    A join on the group whose condition compares: everything stays in the compiled
    stage, and only values inside a stretch leave it.
    """
    found = active.select(*[F.col(c).alias(f"__to_{c}") for c in keys], F.explode("__stretches").alias("__s"))
    found = found.select(*[f"__to_{c}" for c in keys], F.col("__s.lo").alias("__lo"), F.col("__s.hi").alias("__hi"))
    inside = (F.col("__x") >= F.col("__lo")) & (F.col("__x") <= F.col("__hi"))
    for c in keys:
        match = F.col(c).eqNullSafe(F.col(f"__to_{c}"))
        if total is not None and c == total[0]:
            match = match | (F.col(f"__to_{c}") == F.lit(total[1]))
        inside = inside & match
    return long.join(found, inside).select(*[F.col(f"__to_{c}").alias(c) for c in keys], "__x", "__lo", "__hi")


def _settled(counts: DataFrame, keys: list[str], asked: dict) -> tuple[DataFrame, int]:
    """The narrowed cells, written once, and the rows of the largest one that are still open."""
    fields = [counts.schema[c] for c in keys]
    schema = StructType(fields + StructType.fromDDL(_CELL).fields)

    def run(batches):
        for batch in batches:
            column = batch.column("__counts")
            flat = column.flatten()
            lo, hi, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            ends = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).cumsum()
            out = [cells.settle(lo[a:b], hi[a:b], n[a:b], **asked) for a, b in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(len(keys))] + _columns(out), names=schema.names)

    looked = Observation()
    out = stage(counts.mapInArrow(run, schema).observe(looked, F.max("__open").alias("open")))
    return out, looked.get["open"] or 0


def _columns(out: list[cells.Cell]) -> list[pa.Array]:
    def listed(parts: list[int], **fields) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(parts)], pa.int32()),
                                        pa.StructArray.from_arrays([pa.array(np.concatenate(v)) for v in fields.values()], names=list(fields)))

    # A cell that is done needs no buckets any more.
    kept = [c if c.found is None and c.total else None for c in out]
    none = np.empty(0)
    lo, hi = ([getattr(c, f) if c else none for c in kept] for f in ("lo", "hi"))
    n = [c.n if c else none.astype(np.int64) for c in kept]
    flags = [c.open if c else none.astype(bool) for c in kept]
    runs = [_stretches(c) if c else (none, none) for c in kept]
    size = list(map(len, lo))
    empty = not out
    if empty:
        lo, hi, n, flags, runs = [none], [none], [none.astype(np.int64)], [none.astype(bool)], [(none, none)]
    return [pa.array([c.total for c in out], pa.int64()), pa.array([c.open_rows for c in out], pa.int64()),
            listed(size, lo=lo, hi=hi, n=n, open=flags),
            listed([] if empty else [len(r[0]) for r in runs], lo=[r[0] for r in runs], hi=[r[1] for r in runs]),
            pa.array([c.found for c in out], pa.list_(pa.float64())), pa.array([c.before for c in out], pa.int64())]


def _stretches(cell: cells.Cell):
    """Open buckets, neighbours as one stretch."""
    flags = cell.open
    starts = np.flatnonzero(flags & ~np.r_[False, flags[:-1]])
    ends = np.flatnonzero(flags & ~np.r_[flags[1:], False])
    return cell.lo[starts], cell.hi[ends]
