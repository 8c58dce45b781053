import numpy as np
import pytest

from skyledger.operators import calibrate, widths
from skyledger.operators.robust import MAD_SCALE


def width(resid, err, scale, c):
    chi = resid / np.hypot(err, scale * c)
    return MAD_SCALE * np.median(np.abs(chi - np.median(chi)))


def plain_factor(resid, err, scale, target):
    lo, hi = calibrate.FACTOR_MIN, calibrate.FACTOR_MAX
    for _ in range(200):
        middle = 0.5 * (lo + hi)
        lo, hi = (middle, hi) if width(resid, err, scale, middle) > target else (lo, middle)
    return 0.5 * (lo + hi)


def sample(seed, n, shift=0.0, ties=False):
    rng = np.random.default_rng(seed)
    err, scale = rng.uniform(0.01, 0.05, n), rng.uniform(0.05, 0.3, n)
    resid = rng.standard_t(3, n) * np.hypot(err, 1.7 * scale) + shift
    if ties:
        resid, err, scale = np.round(resid, 1), np.full(n, 0.05), np.full(n, 0.25)
    return resid, err, scale


def table(spark, groups):
    rows = [(g, 1.0, float(e), 1.0 + float(r), float(s)) for g, columns in groups.items() for r, e, s in zip(*columns)]
    return spark.createDataFrame(rows + [("A", None, 0.1, 1.0, 0.1), ("A", 1.0, 0.1, 1.0, 0.0), ("none", 1.0, None, 1.0, 0.1)],
                                 "sample string, plx double, e_plx double, plx_sp double, err_sp double")


@pytest.mark.parametrize("few", [1_000_000, 60])
def test_factors_equal_bisection_over_all_rows(spark, monkeypatch, few):
    monkeypatch.setattr(calibrate, "FEW_ROWS", few)
    groups = {"A": sample(1, 1501), "B": sample(2, 2000, shift=0.4), None: sample(3, 300, shift=-0.1)}
    # The residual is formed from the columns, as the operator does.
    as_stored = {g: ((1.0 + r) - 1.0, e, s) for g, (r, e, s) in groups.items()}
    got = calibrate.recalibration_factor(table(spark, groups), ["sample"], target=1.1)
    assert set(got) == {("A",), ("B",), (None,)}
    for g, columns in as_stored.items():
        assert got[(g,)] == pytest.approx(plain_factor(*columns, 1.1), rel=1e-9)


def test_ties_and_roots_beyond_the_bracket(spark, monkeypatch):
    monkeypatch.setattr(calibrate, "FEW_ROWS", 20)
    resid, err, scale = sample(4, 801, ties=True)
    groups = {"A": (resid, err, scale), "wide": (resid * 1e6, err, scale), "narrow": (resid * 1e-9, err, scale)}
    got = calibrate.recalibration_factor(table(spark, groups), ["sample"])
    assert got[("A",)] == pytest.approx(plain_factor((1.0 + resid) - 1.0, err, scale, 1.0), rel=1e-9)
    assert got[("wide",)] == pytest.approx(calibrate.FACTOR_MAX) and got[("narrow",)] == pytest.approx(calibrate.FACTOR_MIN, rel=1e-6)


def test_middle_deviations_far_apart(spark, monkeypatch):
    """Half of the rows deviate little, half much: the root lies between two rows that are not near it."""
    monkeypatch.setattr(calibrate, "FEW_ROWS", 20)
    n = 100
    resid = np.r_[np.tile([-0.25, 0.25], n // 4), np.tile([-2.0, 2.0], n // 4)]
    columns = (resid, np.full(n, 0.01), np.full(n, 0.5))
    got = calibrate.recalibration_factor(table(spark, {"A": columns}), [], target=1.0)
    assert got[()] == pytest.approx(plain_factor((1.0 + resid) - 1.0, *columns[1:], 1.0), rel=1e-9)


def test_no_rows(spark):
    assert calibrate.recalibration_factor(table(spark, {}).limit(0), ["sample"]) == {}


def test_images_keep_the_order():
    x = np.array([-1e308, -1.0, -5e-324, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2), 1e308])
    assert (np.diff(widths.image(x)) > 0).all()
    np.testing.assert_array_equal(widths.value(widths.image(x)), x)


def test_the_width_alone_costs_no_calibration_table(spark, sf, monkeypatch):
    from skyledger.operators import calibrate
    from skyledger.plans.queries import QUERIES

    def refuse(*args, **options):
        raise AssertionError("not asked for")

    monkeypatch.setattr(calibrate, "calibration_bins", refuse)
    assert {r["stage"] for r in QUERIES["probe_z_width"](spark, sf).collect()} == {"before", "after"}


def test_the_table_alone_costs_no_width(spark, sf, monkeypatch):
    from skyledger.operators import calibrate
    from skyledger.plans.queries import QUERIES

    def refuse(*args, **options):
        raise AssertionError("not asked for")

    monkeypatch.setattr(calibrate, "z_report", refuse)
    QUERIES["probe_recalibration"](spark, sf).collect()
