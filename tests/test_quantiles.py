import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from skyledger.operators import cells, quantiles
from skyledger.operators.quantiles import exact_quantiles, select_rank
from skyledger.operators.ranking import ordinal_rank, spearman
from skyledger.operators.robust import MAD_SCALE, quantile_bins, robust_stats
from skyledger.operators.split import exact_half_split

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def frame(spark, values, groups=None):
    groups = groups or ["g"] * len(values)
    values = [None if v is None else float(v) for v in values]
    return spark.createDataFrame(list(zip(groups, values, range(len(values)))), "g string, x double, id long")


def expected(values):
    v = np.array([x for x in values if x is not None])
    return np.quantile(v, PROBS)


CASES = {
    "spread": list(np.random.default_rng(1).normal(size=500)),
    "outliers": [1e300, -1e300, 1e-300] + list(np.random.default_rng(2).normal(size=300)),
    "heavy ties": [1.0] * 300 + [2.0] * 100 + [-3.5] * 7,
    "two close values": [1.0] * 50 + [1.0 + 2e-16 * 2] * 60,
    "exponents": [2.0 ** k for k in range(-400, 400, 7)],
    "one value": [4.25],
    "with nulls": [None, 1.0, None, 2.0, 5.0] * 20,
    "negative and zero": [0.0, -0.0, -1e-9, 1e-9, -7.0] * 15,
}


@pytest.fixture(params=["two passes", "many passes"])
def either(request, monkeypatch):
    """Groups as they come, and all of them taken for groups too large to count by value soon."""
    if request.param == "many passes":
        monkeypatch.setattr(quantiles, "PER_OCTAVE", 1)
        monkeypatch.setattr(quantiles, "PARTS", 3)
        monkeypatch.setattr(quantiles, "FEW_ROWS", 6)


@pytest.mark.parametrize("case", CASES)
def test_quantiles_are_exact(spark, either, case):
    values = CASES[case]
    got = exact_quantiles(frame(spark, values), ["g"], ["x"], PROBS).first()["x"]
    np.testing.assert_allclose(got, expected(values), rtol=1e-14, atol=0)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6).map(lambda v: round(v, 2)), min_size=25, max_size=200))
def test_any_values(spark, values):
    got = exact_quantiles(frame(spark, values), ["g"], ["x"], [0.5, 0.3]).first()["x"]
    np.testing.assert_allclose(got, np.quantile(values, [0.5, 0.3]), rtol=1e-12, atol=1e-12)


def test_hot_group_next_to_small_and_empty_ones(spark, either):
    rng = np.random.default_rng(5)
    values = list(rng.normal(size=400)) + [1.0, 2.0, None, None]
    groups = ["hot"] * 400 + ["small"] * 2 + ["empty"] * 2
    out = {r["g"]: r["x"] for r in exact_quantiles(
        frame(spark, values, groups), ["g"], ["x"], [0.5]).collect()}
    assert out["empty"] is None
    assert out["small"] == [1.5]
    np.testing.assert_allclose(out["hot"], [np.median(values[:400])])


def buckets_of(values, cuts):
    """Values dealt into buckets between cuts, as (lo, hi, n)."""
    values = np.sort(values)
    parts = [p for p in np.split(values, np.searchsorted(values, np.unique(cuts), "right")) if len(p)]
    return [p[0] for p in parts], [p[-1] for p in parts], [len(p) for p in parts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -1.5, -1.0, 0.0, 0.1, 0.5, 2.0, 9.0]) | st.floats(-10, 10), min_size=1, max_size=60),
       st.lists(st.floats(-10, 10), max_size=8))
def test_open_buckets_hold_the_answer_and_singles_give_it(values, cuts):
    values = np.array(values)
    middle = np.median(values)
    mad = np.median(np.abs(values - middle))
    cell = cells.settle(*buckets_of(values, cuts), probs=[0.3, 0.5], spread=True)
    if cell.found is None:
        # Open buckets replaced by their values, the others as they were run together.
        known = [(a, b, n) for a, b, n, o in zip(cell.lo, cell.hi, cell.n, cell.open) if not o]
        for a, b, o in zip(cell.lo, cell.hi, cell.open):
            known += [(v, v, 1) for v in values if o and a <= v <= b]
        cell = cells.settle(*zip(*known), probs=[0.3, 0.5], spread=True)
    np.testing.assert_allclose(cell.found, [np.quantile(values, 0.3), middle, mad], rtol=1e-12, atol=1e-12)
    assert cell.total == len(values)


def test_rows_once_settled_are_not_looked_into_again():
    """The deviation lies in a gap of the left side only: nearer and farther rows there stay two runs."""
    rng = np.random.default_rng(5)
    x = np.sort(np.concatenate([rng.uniform(*ends, 1000) for ends in ((-4, -1.2), (-0.8, 0), (0, 1), (1, 4))]))
    parts = [x[(x >= a) & (x < a + 0.5)] for a in np.arange(-4, 4, 0.5)]
    left = len(x)
    for pieces in (8, 8, len(x)):
        kept = [p for p in parts if len(p)]
        cell = cells.settle([p[0] for p in kept], [p[-1] for p in kept], [len(p) for p in kept], probs=[0.5], spread=True)
        assert cell.open_rows < left
        left, parts = cell.open_rows, []
        for lo, hi, is_open in zip(cell.lo, cell.hi, cell.open):
            inside = x[(x >= lo) & (x <= hi)]
            cut = np.linspace(lo, hi, pieces + 1)[1:-1] if pieces < len(x) else inside[1:]
            parts += np.split(inside, np.searchsorted(inside, cut)) if is_open else [inside]
    kept = [p for p in parts if len(p)]
    done = cells.settle([p[0] for p in kept], [p[-1] for p in kept], [len(p) for p in kept], probs=[0.5], spread=True)
    assert done.found == pytest.approx([np.median(x), np.median(np.abs(x - np.median(x)))])


def test_a_cell_stays_short_however_long_its_group(spark):
    df = spark.range(200_000).select(F.lit("g").alias("g"), (F.sin("id") * F.exp(F.col("id") % 9)).alias("x"))
    found = quantiles._cells(df, ["g"], ["x"], probs=PROBS, spread=True)
    first, left = quantiles._settled(quantiles._counted(
        df.select("g", F.lit("x").alias("__metric"), F.col("x").alias("__x")), ["g", "__metric"], quantiles._digit(F.col("__x"))
    ).groupBy("g", "__metric").agg(F.collect_list(F.struct("lo", "hi", "n")).alias("__counts")), ["g", "__metric"], {"probs": PROBS, "spread": True})
    row = first.first()
    assert 0 < left < 20_000 and len(row["__buckets"]) < 40
    v = np.array([r["x"] for r in df.collect()])
    np.testing.assert_allclose(found.first()["__found"], [*np.quantile(v, PROBS), np.median(np.abs(v - np.median(v)))], rtol=1e-12)


def test_digits_never_fall(spark):
    x = sorted([0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, float(np.nextafter(1.0, 2)), 2.0] + [s * 2.0 ** k * m for s in (1, -1)
               for k in range(-1070, 1020, 13) for m in (1.0, 1.3, 1.9999999999999998)])
    digits = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(quantiles._digit(F.col("x"))).collect()]
    assert digits == sorted(digits)


def test_a_total_over_groups(spark, either):
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=300), 2)
    fold = [["A", "B", None][i % 3] for i in range(300)]
    df = spark.createDataFrame([(i % 2, fold[i], float(v[i])) for i in range(300)], "k int, fold string, x double")
    out = {(r["k"], r["fold"]): r for r in robust_stats(df, ["k", "fold"], ["x"], total=("fold", "all")).collect()}
    assert len(out) == 6
    for (k, f), r in out.items():
        mine = v[[i for i in range(300) if i % 2 == k and f in ("all", fold[i])]]
        np.testing.assert_allclose([r["x_n"], r["x_med"], r["x_scatter"]],
                                   [len(mine), np.median(mine), MAD_SCALE * np.median(np.abs(mine - np.median(mine)))])


def test_nothing_at_all(spark):
    empty = frame(spark, [])
    assert exact_quantiles(empty, ["g"], ["x"], [0.5]).collect() == []
    assert exact_quantiles(empty, [], ["x"], [0.5]).collect()[0]["x"] is None
    row = robust_stats(empty, [], ["x"], extra=[F.count(F.lit(1)).alias("rows")]).collect()
    assert [tuple(r) for r in row] == [(0, None, None, 0)]


def test_robust_stats(spark, either):
    rng = np.random.default_rng(3)
    v = rng.standard_cauchy(300)
    g = ["a" if i % 3 else "b" for i in range(300)]
    out = {r["g"]: r for r in robust_stats(frame(spark, list(map(float, v)), g), ["g"], ["x"],
                                           extra=[F.avg("x").alias("m")]).collect()}
    for name in "ab":
        mine = v[[i for i in range(300) if g[i] == name]]
        assert out[name]["x_n"] == len(mine)
        np.testing.assert_allclose(out[name]["x_med"], np.median(mine))
        np.testing.assert_allclose(out[name]["x_scatter"],
                                   MAD_SCALE * np.median(np.abs(mine - np.median(mine))))
        np.testing.assert_allclose(out[name]["m"], mine.mean())


def test_bins_follow_the_edges(spark, either):
    v = np.round(np.random.default_rng(4).normal(size=200), 1)
    got = {r["id"]: r["bin"] for r in quantile_bins(frame(spark, list(map(float, v))), ["g"], "x", 5).collect()}
    edges = np.quantile(v, np.linspace(0, 1, 6))
    edges[-1] = np.inf
    for i, value in enumerate(v):
        inside = [b for b in range(5) if edges[b] <= value < edges[b + 1]]
        assert inside == [got[i]]


def test_an_edge_between_equal_values_is_that_value(spark, either):
    v = [0.11] * 7 + [round(0.1 + 0.01 * i, 2) for i in range(23)] + [0.3] * 11 + [0.7] * 6
    df = frame(spark, v)
    probs = [i / 13 for i in range(14)]
    got = exact_quantiles(df, ["g"], ["x"], probs).first()["x"]
    sorted_v = sorted(v)
    for p, edge in zip(probs, got):
        low = int(p * (len(v) - 1))
        if sorted_v[low] == sorted_v[min(low + 1, len(v) - 1)]:
            assert edge == sorted_v[low]
    bins = {(r["x"], r["bin"]) for r in quantile_bins(df, ["g"], "x", 13).collect()}
    assert len({x for x, _ in bins}) == len(bins)  # equal rows share a bin


def test_ordinal_ranks_and_correlation(spark):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 12, 150).astype(float), rng.normal(size=150)
    y = y + 0.2 * x
    g = ["hot" if i % 5 else "cold" for i in range(150)]
    df = spark.createDataFrame([(g[i], float(x[i]), float(y[i]), i) for i in range(150)],
                               "g string, x double, y double, id long")
    ranks = {r["id"]: r["rank"] for r in ordinal_rank(df, ["g"], ["x", "id"], "rank").collect()}
    rho = {r["g"]: r["rho"] for r in spearman(df, ["g"], "x", "y", ["id"]).collect()}
    for name in ("hot", "cold"):
        at = np.array([i for i in range(150) if g[i] == name])
        order = at[np.lexsort((at, x[at]))]
        assert [ranks[i] for i in order] == list(range(1, len(at) + 1))
        rx = np.argsort(np.lexsort((at, x[at])))
        ry = np.argsort(np.lexsort((at, y[at])))
        np.testing.assert_allclose(rho[name], np.corrcoef(rx, ry)[0, 1])


def test_half_split_is_exact_however_partitioned(spark, either):
    df = spark.range(301).select("id", (F.col("id") % 3 == 0).alias("train"))
    plain = {r["id"]: r["sample"] for r in exact_half_split(df, ["train"], ["id"]).collect()}
    got = {r["id"]: r["sample"] for r in exact_half_split(df.repartition(7), ["train"], ["id"]).collect()}
    assert got == plain
    for train in (True, False):
        ids = [i for i in range(301) if (i % 3 == 0) == train]
        assert sum(got[i] == "A" for i in ids) == len(ids) // 2


def test_select_rank(spark):
    df = frame(spark, [float(i % 10) for i in range(100)] + [None, float("nan")])
    for by in (["g"], []):
        row = select_rank(df, by, "x", lambda n: n // 2).first()
        assert (row["value"], row["before"], row["total"]) == (5.0, 50, 100)


def test_missing_values_are_left_out(spark):
    values = [float(i) for i in range(40)] + [float("nan")] * 20 + [None, float("inf"), float("-inf")]
    row = robust_stats(frame(spark, values), ["g"], ["x"]).first()
    assert (row["x_n"], row["x_med"]) == (40, 19.5)
    np.testing.assert_allclose(row["x_scatter"], MAD_SCALE * 10.0)
