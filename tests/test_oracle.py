"""A cross-section of the registered queries against their SQL (the driver runs all)."""

import pytest

from tempora.catalog import load
from tempora.catalog.check import compare

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "scan_prices", "verify_bundle", "freshness", "asof_fundamental", "market_cap", "resolve_asset", "resolve_ticker", "cash_flows",
    "membership_spells", "dq_first_price", "dq_bars_after_delisting", "nth_session_after", "trailing_windows", "total_return",
    "reconcile_trailing", "split_factor", "momentum_12_1", "rolling_market_state", "top_quantile", "price_fills", "impact_feedback",
    "drawdown_duration_hourly", "nearest_rank_percentiles", "stationary_bootstrap", "cpcv_splits", "stitch_paths", "trial_variance",
]
QUERIES, ORACLE = load()


def test_every_query_but_file_hashing_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"fingerprint_files"}
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    message, ok = compare(spark, SF, name, QUERIES[name], ORACLE[name])
    assert ok, message
