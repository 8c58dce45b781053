"""Whitening of embeddings by an incremental eigendecomposition.

Every partition keeps the eigendecomposition of its vectors' scatter up to date by
centred rank-one updates (``spectrum``). The partitions' spectra are combined in a
tree, again by rank-one updates, a bounded number of them in a task. One more
distributed pass projects all vectors, centred about the exact mean, on the basis
so found, and the small eigenproblem of that projection turns the basis into the
components (Rayleigh-Ritz). Only matrices as large as the vectors' dimension,
squared, ever meet one task or the driver, never rows.

A vector that is null, holds a null or non-finite entry, or one too large for an
exact integer (2^53 steps), takes no part. Of vectors of different lengths the
commonest length takes part, the longest of equally common ones. Repeated rows
count as often as they stand; a null id is an id. Directions without variance
cannot be whitened and are no components, so one vector, or equal ones, and an
empty table give no rows. Extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyledger.llm.spectrum import Spectrum, centred, deviations
from skyledger.session import stage

# Spectra that one task combines.
FAN_IN = 32
# Rows that a task holds as a matrix at a time.
ROWS_AT_A_TIME = 8192
LARGEST = 2.0 ** 53


@dataclass(frozen=True)
class Whitening:
    """Fitted components, strongest first: ``values`` are variances, the columns of ``vectors`` unit directions."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    steps: float
    shift: int
    identity_error: float | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.vectors / np.sqrt(self.values))


def lattice(df: DataFrame, steps: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The vectors that take part, of any length, as (vec_id, vector of doubles)."""
    vector = F.col(vector_col).cast("array<double>")
    unusable = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c * F.lit(float(steps))) >= LARGEST))
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
            .where(F.col("vector").isNotNull()).where(~unusable))


def fit(df: DataFrame, keep: int = 32, steps: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id",
        vector_col: str = "embedding") -> Whitening | None:
    """The ``keep`` strongest components of the vectors floor(``steps`` * entry) + ``shift``; none without vectors."""
    vectors = lattice(df, steps, id_col, vector_col)
    sizes = vectors.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None or most["dim"] == 0:
        return None
    dim = most["dim"]
    vectors = vectors.where(F.size("vector") == dim)
    whole = _combined(_partition_spectra(vectors, dim, steps, shift))
    basis, _ = np.linalg.qr(whole.vectors)
    n, sums = whole.n, whole.sums

    def projected(x):
        y = centred(x, n, sums) @ basis
        return y.T @ y

    small = _summed(vectors, dim, steps, shift, projected) / n
    values, turn = np.linalg.eigh(0.5 * (small + small.T))
    values, turn = values[::-1], turn[:, ::-1]
    usable = int((values > 16 * dim * np.finfo(float).eps * max(values[0], 0.0)).sum())
    kept = min(keep, usable)
    model = Whitening(n, sums, values[:kept], basis @ turn[:, :kept], float(np.trace(small)), steps, shift)
    if not kept:
        return model

    def moments(x):
        w = np.column_stack([model.project(x), np.ones(len(x))])
        return w.T @ w

    second = _summed(vectors, dim, steps, shift, moments) / n
    cov = second[:-1, :-1] - np.outer(second[-1, :-1], second[-1, :-1])
    error = float(np.abs(cov - np.eye(kept)).max())
    return Whitening(n, sums, model.values, model.vectors, model.trace, steps, shift, error)


def whiten(df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component.

    ``vec_id, component`` from 1, ``n`` vectors fitted, ``deviation`` the sum over
    the dimensions of (n * x - sums)^2 exactly (null beyond 64 bits), ``whitened``,
    ``explained`` share of the variance, ``identity_error`` of the fit.
    """
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    kept, dim = len(model.values), model.dim
    explained = model.values / model.trace
    vectors = lattice(df, model.steps, id_col, vector_col).where(F.size("vector") == dim)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(start, ROWS_AT_A_TIME)
                x = _matrix(part.column("vector"), dim, model.steps, model.shift)
                rows = len(x)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), kept))),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * kept, model.n)),
                    _deviation(x, model).take(pa.array(np.repeat(np.arange(rows), kept))),
                    pa.array(model.project(x).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * kept, model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)


def _deviation(x: np.ndarray, model: Whitening) -> pa.Array:
    whole, rest = deviations(x, model.n, model.sums)
    if rest is None and (not whole.size or int(np.abs(whole).max()) ** 2 * model.dim < 2 ** 63):
        return pa.array((whole * whole).sum(axis=1))
    exact = [sum((int(v) * model.n - s) ** 2 for v, s in zip(row, model.sums)) for row in x]
    return pa.array([v if v < 2 ** 63 else None for v in exact], pa.int64())


def _matrix(column: pa.Array, dim: int, steps: float, shift: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * steps).astype(np.int64).reshape(-1, dim) + shift


def _matrices(batches, dim: int, steps: float, shift: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
            yield _matrix(batch.column(0).slice(start, ROWS_AT_A_TIME), dim, steps, shift)


SPECTRUM = "part long, n long, sums array<decimal(38,0)>, eigenvalues array<double>, eigenvectors array<double>"


def _partition_spectra(vectors: DataFrame, dim: int, steps: float, shift: int) -> DataFrame:
    """The spectrum of each partition that has vectors, written once."""
    def run(batches):
        own = Spectrum(dim)
        for x in _matrices(batches, dim, steps, shift):
            if len(x):
                own.add(x)
        if own.n:
            yield pa.RecordBatch.from_pylist([_row(0, own)], schema=_spectrum_type())

    # Numbered in the file, so that a repeated task does not change which are combined.
    rows = vectors.select("vector").mapInArrow(run, SPECTRUM)
    return stage(rows.withColumn("part", F.spark_partition_id().cast("long")))


def _combined(spectra: DataFrame) -> Spectrum:
    """All spectra in one, ``FAN_IN`` at a time."""
    def merge(key, rows):
        import pandas as pd

        whole = None
        for row in rows.sort_values("part").itertuples():
            one = Spectrum.of(row.n, row.sums, row.eigenvalues, row.eigenvectors)
            if whole is None:
                whole = one
            else:
                whole.merge(one)
        return pd.DataFrame([_row(int(key[0]), whole)])

    while (last := spectra.agg(F.max("part").alias("m")).first()["m"]) > 0:
        groups = F.floor(F.col("part") / FAN_IN) if last >= FAN_IN else F.lit(0)
        spectra = stage(spectra.groupBy(groups.cast("long").alias("group")).applyInPandas(merge, SPECTRUM))
    row = spectra.first()
    return Spectrum.of(row["n"], row["sums"], row["eigenvalues"], row["eigenvectors"])


def _row(part: int, s: Spectrum) -> dict:
    return {"part": part, "n": s.n, "sums": [Decimal(v) for v in s.sums], "eigenvalues": s.values.tolist(),
            "eigenvectors": s.vectors.ravel().tolist()}


def _spectrum_type() -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))),
                      ("eigenvalues", pa.list_(pa.float64())), ("eigenvectors", pa.list_(pa.float64()))])


def _summed(vectors: DataFrame, dim: int, steps: float, shift: int, matrix_of: Callable) -> np.ndarray:
    """The sum of a small square matrix over all vectors: added up by task, then line by line."""
    def run(batches):
        total = None
        for x in _matrices(batches, dim, steps, shift):
            if len(x):
                m = matrix_of(x)
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.tolist())],
                                             names=["line", "entries"])

    def add(key, rows):
        import pandas as pd

        return pd.DataFrame({"line": [key[0]], "entries": [np.sum(np.stack(rows["entries"].to_list()), axis=0)]})

    schema = "line int, entries array<double>"
    lines = vectors.select("vector").mapInArrow(run, schema).groupBy("line").applyInPandas(add, schema)
    return np.array([row["entries"] for row in sorted(lines.collect(), key=lambda r: r["line"])])
