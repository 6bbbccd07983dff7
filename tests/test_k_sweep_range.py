"""The registered sweep covers the reference's k = 2..10."""

from conftest import SF_SMALL
from cohortspark.plans.registry import load_all


def test_k_sweep_covers_two_to_ten(spark):
    got = load_all()["k_sweep"].build(spark, SF_SMALL).select("k", "wcss", "wcss_reduced").collect()
    assert sorted(r.k for r in got) == list(range(2, 11))
    assert all(r.wcss > 0 and r.wcss_reduced > 0 for r in got)
