"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks; a block keeps one sorted list per dimension.
For a query the lists are walked from their best end (the low end where the
query's component is negative), a stretch of every list at a time; what comes up
is scored in full. The components last seen in every list bound the score of all
that has not come up, and the walk ends when that bound is below the kth score
(strictly, so that ties are still settled by the smaller id). The best of the
blocks are merged per query, cut to k on the map side by the window's limit.

Blocks and chunks of queries meet in tiles of a fixed size, so no task holds
more than ``block_rows`` candidates and ``query_rows`` queries, however many
there are or however many are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from skyledger.llm.common import slices
from skyledger.session import stage

BLOCK_ROWS = 1024
QUERY_ROWS = 1024
STRETCH = 32
# Products of whole numbers below this add up exactly in a double.
EXACT = 2.0 ** 23
_LONG = 2 ** 63


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 256.0) -> DataFrame:
    """(vec_id, size, vector): floor(factor * x) of every component as packed doubles.

    Rows whose vector is null, or holds a null or a component that is not finite,
    are left out, and so are rows without an id.
    """
    def run(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("size", pa.int32()), ("vector", pa.binary())])
        for batch in slices(batches, 2048):
            ids, sizes, packed = [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist()):
                if i is None or v is None or any(x is None for x in v):
                    continue
                x = np.floor(factor * np.array(v, dtype=np.float64))
                if np.isfinite(np.array(v, dtype=np.float64)).all() and np.isfinite(x).all():
                    ids.append(i)
                    sizes.append(len(v))
                    packed.append(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).mapInArrow(
        run, StructType.fromDDL("vec_id long, size int, vector binary"))


class Block:
    """Vectors of one block with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.matrix = ids[by_id], matrix[by_id]
        self.order = np.argsort(self.matrix, axis=0, kind="stable")
        self.largest = float(np.abs(self.matrix).max()) if self.matrix.size else 0.0

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if max(self.largest, float(np.abs(query).max()) if query.size else 0.0) < EXACT:
            return self.matrix[rows] @ query
        whole = [int(x) for x in query]  # too large for doubles: whole numbers of any size
        return np.array([sum(int(a) * b for a, b in zip(r, whole)) for r in self.matrix[rows].tolist()], dtype=object)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[list[tuple], int]:
        """[(score, vec_id)] of the k best but the query's own id, and how many were scored."""
        n, dims = self.matrix.shape
        used = np.flatnonzero(query)
        seen = self.ids == query_id
        best: list[tuple] = []
        depth = 0
        scored = 0
        while not seen.all():
            upto = min(n, depth + STRETCH)
            if len(used) == 0:
                upto = n
                fresh = np.flatnonzero(~seen)
            else:
                at = np.where(query[used] > 0, n - 1 - np.arange(depth, upto)[:, None], np.arange(depth, upto)[:, None])
                met = np.zeros(n, dtype=bool)
                met[self.order[at, used]] = True
                fresh = np.flatnonzero(met & ~seen)
            if len(fresh):
                seen[fresh] = True
                scored += len(fresh)
                got = self.scores(fresh, query)
                if len(fresh) > 4 * k and got.dtype != object:  # only what can still be among the best
                    cut = np.partition(got, len(got) - k)[len(got) - k]
                    keep = got >= cut
                    fresh, got = fresh[keep], got[keep]
                best = sorted(best + [(int(s), int(i)) for s, i in zip(got.tolist(), self.ids[fresh].tolist())],
                              key=lambda x: (-x[0], x[1]))[:k]
            depth = upto
            if depth >= n:
                break
            if len(best) == k:
                last = np.where(query[used] > 0, self.matrix[self.order[n - depth, used], used], self.matrix[self.order[depth - 1, used], used])
                bound = sum(int(a) * int(b) for a, b in zip(last.tolist(), query[used].tolist()))
                if bound < best[-1][0]:
                    break
        return best, scored


def _unpack(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, size)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest of every query against all rows but those of its own id.

    ``is_query`` is a condition on ``vec_id``. Ties go to the smaller id; repeated
    rows are candidates each, and queries each with k rows of their own. Only
    vectors of the query's length are compared.
    Scores beyond a long are cut to its limits. An empty table gives none.
    """
    # The row number is written with the row: it tells repeated query rows apart, and deals rows out.
    rows = stage(whole_vectors(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("deal", F.xxhash64("vec_id", "row"))
    queries = rows.where(is_query)
    blocks = max(1, -(-rows.count() // block_rows))
    chunks = max(1, -(-queries.count() // query_rows))
    cells = StructType.fromDDL("query_row long, query_id long, vec_id long, score long")
    empty = pa.schema([(c, pa.int64()) for c in cells.names])

    every_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select("size", F.pmod("deal", F.lit(blocks)).cast("int").alias("block"), every_chunk.alias("chunk"), "vec_id", "vector")
    right = queries.select("size", every_block.alias("block"), F.pmod(F.shiftright("deal", 20), F.lit(chunks)).cast("int").alias("chunk"), "row", "vec_id", "vector")

    def tile(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        if not candidates.num_rows or not asked.num_rows:
            return empty.empty_table()
        size = candidates.column("size")[0].as_py()
        block = Block(candidates.column("vec_id").to_numpy(), _unpack(candidates.column("vector"), size))
        out = []
        for row, q, vector in zip(asked.column("row").to_pylist(), asked.column("vec_id").to_pylist(), _unpack(asked.column("vector"), size)):
            out += [(row, q, i, max(-_LONG, min(_LONG - 1, s))) for s, i in block.top(q, vector, k)[0]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], schema=empty)

    found = left.groupBy("size", "block", "chunk").cogroup(right.groupBy("size", "block", "chunk")).applyInArrow(tile, cells)
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
