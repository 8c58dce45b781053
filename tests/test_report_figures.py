"""The report counts only the values that its wanted figures need."""

import pytest

from skyledger.operators import evaluate as ev, quantiles
from skyledger.plans.tables import messy


@pytest.mark.parametrize("figures, values", [(["robust_frac_scatter"], ["frac"]), (["chi2_mean_chi2", "chi2_n"], ["chi", "chi2"]), ([], [])])
def test_wanted_figures_equal_the_whole_report(spark, sf, figures, values, monkeypatch):
    cat = messy(spark, sf)
    whole = {r["fold"]: r for r in ev.evaluate(cat).collect()}
    counted = []
    cells = quantiles._cells
    monkeypatch.setattr(quantiles, "_cells", lambda df, by, values, **k: counted.extend(values) or cells(df, by, values, **k))
    got = ev.evaluate(cat, figures=figures)
    assert got.columns == ["fold", "n_total", "n_hi_snr_probe", *figures]
    assert counted == values
    assert {r["fold"]: tuple(r) for r in got.collect()} == {f: tuple(r[c] for c in got.columns) for f, r in whole.items()}
