"""The member listing sorts only the columns it shows."""

from skyledger.operators import clusters
from skyledger.plans.queries import QUERIES


def test_member_chi_sorts_narrow_rows(spark, sf, monkeypatch):
    seen, rank = [], clusters.ordinal_rank
    monkeypatch.setattr(clusters, "ordinal_rank", lambda df, *rest: seen.append(df.columns) or rank(df, *rest))
    assert QUERIES["member_chi"](spark, sf).columns == ["sdss_id", "cluster", "chi", "chi_rank"]
    assert seen == [["sdss_id", "cluster", "plx_sp", "err_sp", "chi"]]
