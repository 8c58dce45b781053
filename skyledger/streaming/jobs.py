"""Structured Streaming jobs over arriving files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyledger.operators.fit import LinearModel
from skyledger.operators.scoring import predict
from skyledger.operators.spectra import matrix


class SettingsChanged(ValueError):
    """A checkpoint belongs to a run with other settings."""


def guard_settings(spark: SparkSession, checkpoint: str, settings: Mapping[str, object]) -> None:
    """Refuse to resume a checkpoint that was started with other settings."""
    text = json.dumps(dict(settings), sort_keys=True)
    path = f"{checkpoint.rstrip('/')}-settings"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(folder):
        old = spark.read.json(path, schema="settings string").first()["settings"]
        if old != text:
            raise SettingsChanged(f"{checkpoint} was started with {old}, now {text}")
    else:
        spark.createDataFrame([(text,)], "settings string").coalesce(1).write.json(path)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000,
                pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def table_source(path: str) -> str:
    """The path by which to stream a table that may be one file or a folder of files.

    A stream takes a plain path for a folder; a pattern that only this name matches stands for either.
    """
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/{{{name}}}"


def ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str,
           work: Callable[[DataFrame], DataFrame], settings: Mapping[str, object],
           pattern: str | None = None) -> StreamingQuery:
    """Process what has arrived and stop; a later run takes up only new files."""
    guard_settings(spark, checkpoint, settings)
    out = work(file_stream(spark, source, schema, pattern=pattern))
    return (out.writeStream.format("parquet").option("path", target)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def members_scored(stream: DataFrame, members: DataFrame, key: str, model: LinearModel,
                   carry: Sequence[str]) -> DataFrame:
    """Arriving rows of known members, scored with a saved model (stateless)."""
    return predict(stream.join(members.select(key), key, "left_semi"), model, carry)


def running_state(counted: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Keep the totals of a streaming aggregate as a table; Spark's state store holds the running sums."""
    def replace(totals: DataFrame, number: int) -> None:
        totals.write.mode("overwrite").parquet(state)

    return (counted.writeStream.outputMode("complete").foreachBatch(replace)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def running_counts(stream: DataFrame, keys: Sequence[str], hit: Column, state: str,
                   checkpoint: str) -> StreamingQuery:
    """Running hits of a predicate and rows per key."""
    return running_state(stream.groupBy(*keys).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n")),
                         state, checkpoint)


def running_pixel_counts(stream: DataFrame, state: str, checkpoint: str, group: str = "telescope",
                         flags: str = "pixel_flags") -> StreamingQuery:
    """Running per-telescope, per-pixel hit counts of flagged spectra.

    The state is one vector of counts per telescope. Every task adds its spectra
    into a vector first, so a telescope that sends a third of all rows reaches its
    state as a few vectors, and the store holds and logs one value for it, not one
    for each pixel. A finished batch writes the telescopes it has changed; a batch
    that is run again after a failure replaces its own rows.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            labels = np.asarray([str(v) for v in batch.column(0).to_pylist()])
            for name in np.unique(labels):
                mine = np.flatnonzero(labels == name)
                hits = (matrix(batch.column(1).take(pa.array(mine))) != 0).sum(axis=0).astype(np.int64)
                sums[name] = _added(name, sums.get(name), hits)
                rows[name] = rows.get(name, 0) + len(mine)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64())),
                 pa.array(list(rows.values()), pa.int64())], names=["grp", "hits", "n"])

    def add(key, parts, held: GroupState):
        import pandas as pd

        total, n = (np.array(held.get[0], np.int64), held.get[1]) if held.exists else (None, 0)
        for part in parts:
            for hits, more in zip(part["hits"], part["n"]):
                total, n = _added(key[0], total, np.asarray(hits, np.int64)), n + int(more)
        held.update((total.tolist(), n))
        yield pd.DataFrame({"grp": [key[0]], "hits": [total.tolist()], "n": [n]})

    vectors = stream.select(group, flags).mapInArrow(partial, "grp string, hits array<long>, n long")
    totals = vectors.groupBy("grp").applyInPandasWithState(
        add, "grp string, hits array<long>, n long", "hits array<long>, n long", "update", GroupStateTimeout.NoTimeout)

    def write(changed: DataFrame, number: int) -> None:
        changed.withColumnRenamed("grp", group).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return (totals.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _added(name: str, total: np.ndarray | None, part: np.ndarray) -> np.ndarray:
    if total is None:
        return part
    if len(total) != len(part):
        raise ValueError(f"spectra of {name} differ in length")
    return total + part


def latest_pixel_counts(spark: SparkSession, state: str, group: str = "telescope") -> DataFrame:
    """(telescope, pixel, hits, n) after the last finished batch."""
    vectors = spark.read.option("basePath", state).parquet(f"{state}/batch=*")
    last = vectors.groupBy(group).agg(F.max_by(F.struct("hits", "n"), "batch").alias("v"))
    return last.select(group, F.posexplode("v.hits").alias("pixel", "hits"), F.col("v.n").alias("n"))


def latest_counts(spark: SparkSession, state: str) -> DataFrame:
    """The totals after the last finished batch."""
    return spark.read.parquet(state)
