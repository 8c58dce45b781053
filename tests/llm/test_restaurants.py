"""One restaurant for every previous word: exact base figures, probabilities that add up, contexts kept apart."""

import math
import zlib

import numpy as np
import pytest

from skyledger.llm import pitman_yor as P, restaurants as R
from test_pitman_yor import plain_base

LEARNT = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10]
HELD = [i for i in range(40000) if zlib.crc32(str(i).encode()) % 10 == 0]


def scores(spark, learnt, held, **options):
    """Held-out scores in the order of ``held``."""
    docs = list(zip(LEARNT, learnt)) + list(zip(HELD, held))
    got = {r["doc_id"]: r["score"] for r in R.fit_and_score(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()}
    return np.array([got[i] for i in HELD[:len(held)]])


def test_words_of_one_hash_class_are_different_contexts(spark):
    first = "w0"
    other = next(f"w{k}" for k in range(1, 10_000) if P.bucket(f"w{k}".encode(), 128) == P.bucket(b"w0", 128))
    good, bad = scores(spark, [f"{first} a", f"{other} b"] * 200, [f"{first} a", f"{first} b"])
    assert good > bad + 1


@pytest.mark.parametrize("cell_bytes", [10 ** 9, 100])
def test_probabilities_add_up(spark, cell_bytes):
    rng = np.random.default_rng(1)
    learnt = [" ".join(f"w{k}" for k in np.minimum(rng.geometric(0.3, 6), 8)) for _ in range(200)]
    words = [f"w{k}" for k in range(1, 9)] + ["unknown"]
    held = ["", *words, *[f"{u} {w}" for u in words for w in words]]
    got = 10 ** scores(spark, learnt, held, cell_bytes=cell_bytes)
    # The matrix of p(w | u), scaled by a diagonal matrix and its inverse: rows that add up to one have the eigenvalue one.
    n = len(words)
    scaled = np.ones((n + 1, n + 1))
    scaled[0, 0], scaled[1:, 0] = got[0], got[1:n + 1]
    scaled[1:, 1:] = got[n + 1:].reshape(n, n) / got[1:n + 1]
    assert max(abs(np.linalg.eigvals(scaled))) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("cell_bytes", [10 ** 9, 200])
def test_edges_of_the_table(spark, cell_bytes, monkeypatch):
    rows = [(1, None, 1.0), (2, "", 2.0), (3, "a b A", 3.0), (3, "a b A", 3.0), (None, "zz", 0.0), (4, "word " * 5_000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    want = plain_base([(i, t) for i, t, _ in rows])
    got = R.fit_and_score(df, cell_bytes=cell_bytes).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == sorted(
        (str(i), want[i, t][1], want[i, t][2], round(want[i, t][4], 6)) for i, t, _ in rows)
    assert all(math.isfinite(r["score"]) for r in got)
    assert R.fit_and_score(df.limit(0)).collect() == []
    held = df.where(P.held_out("doc_id"))
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in R.fit_and_score(held).collect())


def test_better_than_hash_classes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = R.fit_and_score(docs).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    coarse = P.score(docs, P.fit(P.texts(docs).where(~P.held_out()))).where("held_out").selectExpr("sum(score) AS s").first()
    assert held["s"] > coarse["s"] > held["b"]


def test_a_flush_lets_go_of_its_arrays(monkeypatch):
    """Two tasks share an executor, so a flush may take no more than 80 bytes a place."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr("pyspark.TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 2000, 999)) for _ in range(512)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(512)), "text": texts, "held_out": [i % 10 == 0 for i in range(512)]})
    cut = R._cut((2, 2), True)([pa.RecordBatch.from_arrays([c.slice(k, 64) for c in batch.columns], names=batch.schema.names) for k in range(0, 512, 64)])
    tracemalloc.start()
    sizes = [b.nbytes for b in cut]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes and peak / 512_000 < 80
