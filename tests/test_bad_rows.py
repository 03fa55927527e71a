"""One bad row gets a status, or is left out, and never stops the good ones."""

import datetime as dt

import pytest

from tempora.operators import curves as C
from tempora.operators.costs import price_fills
from tempora.operators.crossval import dq_cv_inputs
from tempora.operators.portfolio import costed_nav_path, portfolio_nav, top_quantile
from tempora.plans.asof import asof_join

D = dt.date(2020, 1, 1)


def day(n):
    return D + dt.timedelta(days=n)


def test_names_without_a_score_are_not_ranked(spark):
    rows = [(D, 1, None), (D, 2, 5.0), (D, 3, 4.0), (D, 4, 3.0), (D, 5, 2.0), (D, 6, float("nan"))]
    got = top_quantile(spark.createDataFrame(rows, "dt date, asset_id int, score double"), q=2).collect()
    assert [(r.asset_id, r.weight) for r in sorted(got, key=lambda r: r.asset_id)] == [(2, 0.5), (3, 0.5)]


def test_a_market_state_without_volume(spark):
    bars = spark.createDataFrame([(a, day(i), 10.0, 10.0) for a in (1, 2) for i in range(2)], "asset_id int, dt date, open double, closeunadj double")
    orders = spark.createDataFrame([(a, day(1), 5.0, "CLOSE") for a in (1, 2)], "asset_id int, dt date, shares double, fill_model string")
    state = spark.createDataFrame([(1, day(1), 0.1, 0.0, 1e6), (2, day(1), 0.1, 1e4, 1e6)], "asset_id int, dt date, sigma_d double, v_d double, theta double")
    got = {r.asset_id: r for r in price_fills(orders, bars, state).collect()}
    assert got[1].status == "bad_market_state" and got[1].fill_price is None
    assert got[2].status == "ok" and got[2].fill_price > 10


CURVES = [("zero", day(0), 0.0), ("zero", day(1), 1.0), ("one", day(0), 5.0), ("good", day(0), 1.0), ("good", day(1), 2.0), ("good", day(2), 1.5)]


def test_short_and_zero_curves(spark):
    curves = spark.createDataFrame(CURVES, "curve_id string, dt date, nav double")
    dd = {r.curve_id: r for r in C.max_drawdown(curves).collect()}
    assert (dd["zero"].status, dd["one"].status, dd["good"].max_drawdown) == ("non_positive_start", "too_short", 0.25)
    assert {r.curve_id: r.status for r in C.sharpe(C.curve_returns(curves), curves=curves).collect()} == {"zero": "too_short", "one": "too_short", "good": "ok"}
    card = {r.curve_id: r for r in C.scorecard(curves).collect()}
    assert card["one"].status == "too_short" and card["zero"].total_return is None and card["good"].total_return == 0.5
    assert {r.curve_id for r in C.performance(curves).collect()} == {"zero", "one", "good"}
    assert {r.curve_id: r.year_return for r in C.by_year(curves).collect()}["zero"] is None
    assert {r.curve_id: r.status for r in C.calmar(curves).collect()} == {"zero": "too_short", "one": "too_short", "good": "too_short"}


def test_a_price_of_zero_is_no_price(spark):
    bars = spark.createDataFrame([(1, day(i), 10.0 + i) for i in range(3)] + [(2, day(i), 0.0) for i in range(3)], "asset_id int, dt date, closeunadj double")
    weights = spark.createDataFrame([("a", D, 1, 0.5), ("a", D, 2, 0.5)], "curve_id string, dt date, asset_id int, weight double")
    nav = {r.dt: r.nav for r in portfolio_nav(weights, bars, None, capital=100.0).collect()}
    assert nav[day(2)] == pytest.approx(120.0)


def test_trades_without_a_market_state_are_counted(spark):
    bars = spark.createDataFrame([(1, day(i), 10.0 + i) for i in range(3)], "asset_id int, dt date, closeunadj double")
    weights = spark.createDataFrame([("a", D, 1, 1.0)], "curve_id string, dt date, asset_id int, weight double")
    nothing = spark.createDataFrame([], "asset_id int, dt date, sigma_d double, v_d double, theta double")
    opening, _, _ = costed_nav_path(weights, bars, None, nothing, capital=100.0)
    assert [r.n_unquoted for r in opening.collect()] == [1]
    with pytest.raises(Exception, match="no market state: asset 1"):
        costed_nav_path(weights, bars, None, nothing, capital=100.0, strict=True)


def test_asof_keeps_rows_that_match_nothing(spark):
    left = spark.createDataFrame([(1, day(5), "x"), (1, day(5), "x"), (None, day(5), "y"), (1, None, "z")], "k int, t date, tag string")
    right = spark.createDataFrame([(1, day(1), 7), (None, day(1), 8)], "k int, u date, v int")
    for way in ("backward", "forward"):
        got = asof_join(left, right, by=["k"], left_ts="t", right_ts="u", payload=["v"], direction=way).collect()
        assert sorted((r.tag, r.v or 0) for r in got) == [("x", 7 * (way == "backward")), ("x", 7 * (way == "backward")), ("y", 0), ("z", 0)]
    plan = asof_join(left, right, by=["k"], left_ts="t", right_ts="u", payload=["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") <= 2 and "Join" not in plan


def test_repeated_dates_are_reported(spark):
    obs = spark.createDataFrame([(D, day(1)), (D, day(1)), (day(2), day(3))], "dt date, label_end date")
    assert {r.problem for r in dq_cv_inputs(obs, groups=2).collect()} == {"repeated_dt"}
