import math

import numpy as np
import pytest

from skyledger.llm import queries, spectrum, whitening


def eigen(a):
    values, vectors = np.linalg.eigh(a)
    return values, vectors


@pytest.mark.parametrize("case", ["random", "equal", "zero", "tiny", "aligned"])
def test_rank_one_update(case):
    rng = np.random.default_rng(3)
    d = 24
    values = np.sort(rng.random(d)) * 10
    vectors, _ = np.linalg.qr(rng.normal(size=(d, d)))
    z = rng.normal(size=d)
    if case == "equal":
        values[4:15] = values[4]
        values[20] = values[19] * (1 + 1e-16)
    if case == "zero":
        values[:] = 0
    if case == "tiny":
        z *= 1e-9
    if case == "aligned":
        z = vectors[:, 7] * 3
    before = vectors @ np.diag(values) @ vectors.T + np.outer(z, z)
    got, q = spectrum.rank_one(values, vectors, z)
    assert np.allclose(q.T @ q, np.eye(d), atol=1e-13)
    assert np.allclose(q @ np.diag(got) @ q.T, before, atol=1e-13 * max(1, np.abs(before).max()) * 10)


def test_thousands_of_updates_stay_orthogonal():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (6000, 16)) + 1_000_000
    x[:, 3] = x[:, 5]  # one direction without variance
    own = spectrum.Spectrum(16)
    for k in range(0, 6000, 7):
        own.add(x[k:k + 7])
    y = x - x.mean(axis=0)
    assert own.n == 6000 and own.sums == x.sum(axis=0).tolist()
    assert np.allclose(own.vectors.T @ own.vectors, np.eye(16), atol=1e-11)
    assert np.allclose(np.sort(own.values), eigen(y.T @ y)[0], rtol=1e-10, atol=1e-4)


def test_merged_spectra_equal_one():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (500, 8)) * np.arange(1, 9)
    parts = []
    for k in range(0, 500, 90):
        one = spectrum.Spectrum(8)
        one.add(x[k:k + 90])
        parts.append(one)
    whole = spectrum.Spectrum(8)
    for p in parts:
        whole.merge(p)
    y = x - x.mean(axis=0)
    assert np.allclose(np.sort(whole.values), eigen(y.T @ y)[0], rtol=1e-12)


def table(spark, rows, path):
    spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, n double").write.parquet(
        f"{path}/embeddings.parquet")
    return str(path)


def check(spark, path, rows, keep=32):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good])
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    values, vectors = eigen(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = queries.op12_embedding_whitening(spark, path).collect()
    components = min(keep, x.shape[1])
    assert len(got) == n * components
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    for c, rows_c in by.items():
        want = y @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        want = sorted(zip([i for i, _ in good], deviation.tolist(), want.tolist()))
        have = sorted((r.vec_id, r.deviation, r.whitened) for r in rows_c)
        assert [h[:2] for h in have] == [w[:2] for w in want]
        a, b = np.array([h[2] for h in have]), np.array([w[2] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert all(r.n == n and abs(r.explained - values[c - 1] / values.sum()) < 1e-10 for r in rows_c)
        assert all(r.identity_error < 1e-9 for r in rows_c)


def test_query_equals_a_dense_solution(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(spark, sf, rows)


def test_edges_and_a_tree_of_spectra(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(120)]
    rows += [(0, rows[0][1]), (500, None), (501, [1.0, None, 2.0, 3.0, 4.0]), (502, [float("nan")] + [1.0] * 4),
             (503, [float("inf")] * 5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(11).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(spark, str(tmp_path), rows)


def test_other_lengths_and_huge_entries_take_no_part(spark, tmp_path):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(50)] + [(90, [1.0]), (91, []), (92, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = whitening.whiten(df, whitening.fit(df))
    assert {r.vec_id for r in out.collect()} == set(range(50)) and out.count() == 100


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 9, [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(df, whitening.fit(df)).collect() == []


def test_a_deviation_beyond_64_bits_is_null(spark):
    df = spark.createDataFrame([(i, [float(i) * 2.0 ** 33, 0.0]) for i in range(4)], "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in whitening.whiten(df, whitening.fit(df)).collect()}
    assert all(r.deviation is None and r.component == 1 for r in out.values()) and len(out) == 4
    assert abs(out[3].whitened) == pytest.approx(1.5 / math.sqrt(1.25), rel=1e-12)
