"""The threshold algorithm against brute force, ties and odd vectors included."""

import math
import random

import pytest

from pyspark.sql import functions as F
from skyledger.llm import topk as T
from skyledger.llm.queries import ORACLES, QUERIES


def plain(rows, every, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block_rows,query_rows", [(3, 2), (16, 4), (1024, 1024)])
def test_matches_brute_force(spark, block_rows, query_rows):
    rng = random.Random(4)
    rows = [(i, [round(rng.uniform(-1, 1), 2) for _ in range(6)]) for i in range(90)]
    rows += [(100 + i, [0.5, -0.5, 0.25, 0.0, 0.0, 1.0]) for i in range(40)]  # a third of all rows are equal
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6),
             (204, [0.0] * 6), (205, [1.0, 2.0]), (210, [2.0, 1.0]), (None, [1.0] * 6), (220, [3e7, 1e9, -1e12, 0.1, 0.2, 0.3])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = T.top_k(df, F.col("vec_id") % 10 == 0, 5, block_rows=block_rows, query_rows=query_rows)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 10, 5)
    assert T.top_k(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_the_walk_stops_early():
    import numpy as np
    rng = np.random.default_rng(1)
    matrix = np.floor(np.exp(rng.normal(0, 2, (2000, 3))) * 10)
    block = T.Block(np.arange(2000), matrix)
    best, scored = block.top(-1, np.array([3.0, 1.0, 2.0]), 5)
    scores = matrix @ np.array([3.0, 1.0, 2.0])
    assert [s for s, _ in best] == sorted(scores.astype(int).tolist(), reverse=True)[:5]
    assert scored < 1000


def test_query_matches_sql(spark, sf):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(ORACLES["op10_threshold_topk"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op10_threshold_topk"](spark, sf).collect()) == want


def test_repeated_query_rows_have_k_rows_each(spark):
    rows = [(50, [2.0, 1.0]), (50, [2.0, 1.0]), (50, [-1.0, 0.0])] + [(i, [float(8 - i), 1.0]) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in T.top_k(df, F.col("vec_id") % 50 == 0, block_rows=3, query_rows=1).collect())
    want = []
    for q in ([2.0, 1.0], [2.0, 1.0], [-1.0, 0.0]):
        scores = sorted(((int(sum(256 * a * 256 * b for a, b in zip(q, v))), i) for i, v in rows if i != 50), key=lambda s: (-s[0], s[1]))[:5]
        want += [(k + 1, i, s) for k, (s, i) in enumerate(scores)]
    assert got == sorted(want)
