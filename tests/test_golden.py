"""Answers known in advance."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tempora.functions import costs as K
from tempora.functions import normal as N
from tempora.operators import calendar as C
from tempora.operators import costs as CO
from tempora.operators import crossval as CV
from tempora.operators import curves as CU
from tempora.operators import membership as MB
from tempora.operators import momentum as MO
from tempora.operators import portfolio as P
from tempora.operators import quality as Q
from tempora.operators import returns as R
from tempora.operators import scenarios as S
from tempora.operators import trials as T

D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_total_return_three_days(spark):
    bars = spark.createDataFrame([(1, day(i), p) for i, p in enumerate([100.0, 101.0, 100.5, 102.0])], "asset_id int, dt date, closeunadj double")
    div = spark.createDataFrame([(1, day(2), 1.5)], "asset_id int, ex_date date, amount_per_share double")
    tr = [r.tr for r in R.total_return(bars, div).orderBy("dt").collect()]
    assert tr == pytest.approx([1.0, 1.01, 1.02, 1.0352238806], abs=1e-9)


def test_step_rate_takes_the_new_rate_on_its_day(spark):
    days = [dt.date(2003, 10, 31), dt.date(2003, 11, 1), dt.date(2003, 11, 3), dt.date(1990, 1, 1)]
    sched = spark.createDataFrame([(dt.date(1993, 1, 22), 0.0012), (dt.date(2003, 11, 1), 0.000945)], "effective_from date, rate double")
    got = {r.dt: (r.rate, r.status) for r in R.step_rate(spark.createDataFrame([(d,) for d in days], "dt date"), sched).collect()}
    assert got[days[0]] == (0.0012, "ok") and got[days[1]] == (0.000945, "ok") and got[days[2]] == (0.000945, "ok")
    assert got[days[3]] == (None, "before_schedule")


def test_sharpe_inference(spark):
    row = spark.range(1)
    val = lambda c: row.select(c.alias("x")).first().x
    lit = F.lit
    assert val(N.dsr(lit(1.5), lit(60), lit(-0.5), lit(5.0), lit(0.4), lit(30))) == pytest.approx(0.766, abs=1e-3)
    assert val(N.dsr(lit(0.2), lit(60), lit(0.0), lit(3.0), lit(9.0), lit(1))) == pytest.approx(val(N.psr(lit(0.2), lit(0.0), lit(60), lit(0.0), lit(3.0))))
    assert val(N.normal_quantile(lit(0.975))) == pytest.approx(1.959963985, abs=1e-8)
    for z in (-38.0, -8.2, -3.0, -0.4, 0.0, 0.7, 2.5, 7.5, 40.0):
        assert val(N.normal_cdf(lit(z))) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-14)
    assert val(N.psr(lit(0.1), lit(0.0), lit(1), lit(0.0), lit(3.0))) is None
    assert val(N.min_trl(lit(0.1), lit(0.2), 0.05, lit(0.0), lit(3.0))) is None
    sr, g3, g4 = 0.9, -0.3, 4.0
    want = 1 + (1 - g3 * sr + (g4 - 1) / 4 * sr**2) * (1.6448536 / sr) ** 2
    assert val(N.min_trl(lit(sr), lit(0.0), 0.05, lit(g3), lit(g4))) == pytest.approx(want, abs=1e-5)


NAVS = [100, 105, 110, 115, 110, 108, 105, 100, 105, 110, 115, 120, 115, 110, 105, 100, 95, 90, 85, 80, 75, 70]


def curve(spark, navs, name="a"):
    return spark.createDataFrame([(name, day(i), float(x)) for i, x in enumerate(navs)], "curve_id string, dt date, nav double")


def test_drawdown_of_22_bars(spark):
    c = curve(spark, NAVS)
    assert one(CU.max_drawdown(c)).max_drawdown == pytest.approx(50 / 120)
    d = one(CU.drawdown_duration(c))
    assert (d.duration_bars, d.censored, d.peak_dt, d.trough_dt) == (10, True, day(11), day(21))
    assert one(CU.calmar(c)).calmar == pytest.approx(-2.366780910718, abs=1e-9)
    flat = one(CU.drawdown_duration(curve(spark, [1, 2, 3])))
    assert (flat.duration_bars, flat.censored, flat.peak_dt, flat.trough_dt) == (0, False, day(0), None)
    assert one(CU.calmar(curve(spark, [1, 2, 3]))).status == "too_short"
    card = one(CU.scorecard(c))
    assert (card.duration_bars, card.censored, card.longest_win, card.longest_loss) == (10, True, 4, 10)
    assert card.max_drawdown == pytest.approx(50 / 120)


def test_hhi_and_streaks(spark):
    pnl = spark.createDataFrame([("a", x) for x in (10.0, -10.0, 5.0, -5.0)] + [("b", 0.0)], "curve_id string, pnl double")
    got = {r.curve_id: (r.hhi, r.status) for r in CU.hhi(pnl).collect()}
    assert got["a"][0] == pytest.approx(250 / 900) and got["b"] == (None, "zero_total")
    r = spark.createDataFrame([("a", day(i), x) for i, x in enumerate([0.1, 0.2, 0.0, 0.1, -0.1, -0.2, -0.1, 0.0, 0.3])], "curve_id string, dt date, r double")
    runs = one(CU.longest_runs(r))
    assert (runs.longest_win, runs.longest_loss) == (2, 3)


def test_folds_put_the_remainder_first(spark):
    obs = spark.createDataFrame([(day(i), day(i)) for i in range(11)], "dt date, label_end date")
    got = [(r.fold, r.idx_start, r.idx_end + 1) for r in CV.fold_bounds(CV.contiguous_folds(obs, 3)).orderBy("fold").collect()]
    assert got == [(0, 0, 4), (1, 4, 8), (2, 8, 11)]


def test_purged_kfold_with_embargo(spark):
    obs = spark.createDataFrame([(day(i), day(i)) for i in range(20)], "dt date, label_end date")
    rows = CV.purged_kfold(obs, k=5, embargo_pct=0.05).collect()
    role = lambda s, r: sorted(x.obs_idx for x in rows if x.split_id == s and x.role == r)
    assert role(0, "test") == [0, 1, 2, 3] and role(0, "embargo") == [4] and role(0, "train") == list(range(5, 20))
    assert role(4, "embargo") == [] and role(4, "test") == [16, 17, 18, 19]
    longer = spark.createDataFrame([(day(i), day(i + 2)) for i in range(20)], "dt date, label_end date")
    purged = [x.obs_idx for x in CV.purged_kfold(longer, k=5, embargo_pct=0.0).collect() if x.split_id == 1 and x.role == "purged"]
    assert sorted(purged) == [2, 3]


def test_cpcv_counts(spark):
    paths = CV.cpcv_paths(spark, 6, 2).collect()
    assert CV.path_count(6, 2) == 5 and len(CV.combinations(6, 2)) == 15
    assert len({p.path for p in paths}) == 5 and len(paths) == 30
    assert {n for n in [sum(p.split_id == s for p in paths) for s in range(15)]} == {2}
    assert CV.dq_path_partition(CV.cpcv_paths(spark, 6, 2), CV.split_groups(spark, 6, 2), 6).count() == 0


def test_three_orders_cost_bands(spark):
    rows = [(2000.0, 80e6), (-1500.0, 81e6), (5000.0, 79.5e6)]
    df = spark.createDataFrame([(i, q, 0.012, v, 8.7e9) for i, (q, v) in enumerate(rows)], "i int, shares double, s double, v double, th double")
    perm, temp = K.impact_bps(F.col("shares"), F.col("s"), F.col("v"), F.col("th"))
    got = df.select("i", perm.alias("p"), temp.alias("t"), K.exact_commission(F.col("shares"), "0.005").alias("c")).orderBy("i").collect()
    for r, (plo, phi), (tlo, thi), c in zip(
        got, [(0.0014, 0.0016), (0.0010, 0.0013), (0.0037, 0.0041)], [(0.029, 0.031), (0.023, 0.025), (0.050, 0.053)], [10, 7.5, 25]
    ):
        assert plo <= r.p <= phi and tlo <= r.t <= thi and float(r.c) == c
    with pytest.raises(ValueError):
        K.zero_cost(unsuitable_for_deployment=False)


def test_spells(spark):
    years = [dt.date(y, 12, 31) for y in (1995, 2010, 2013, 2015, 2026)]
    rows = [(y, 1) for y in years] + [(years[1], 2), (years[2], 2)]
    got = {(r.asset_id, r.spell_start, r.spell_end) for r in MB.membership_spells(spark.createDataFrame(rows, "snapshot_date date, asset_id int")).collect()}
    assert got == {(1, years[0], None), (2, years[1], years[2])}


def momentum_of(spark, bars, divs=(), splits=(), at=dt.date(2021, 6, 30)):
    b = spark.createDataFrame([(1, d, float(p)) for d, p in bars], "asset_id int, dt date, closeunadj double")
    v = spark.createDataFrame([(1, d, a) for d, a in divs], "asset_id int, ex_date date, amount_per_share double")
    s = spark.createDataFrame([(1, d, r) for d, r in splits], "asset_id int, ex_date date, ratio double")
    req = spark.createDataFrame([(1, at)], "asset_id int, dt date")
    return [r.score for r in MO.momentum_scores(req, MO.momentum_index(b, v, s)).collect()]


def test_momentum_window(spark):
    at = dt.date(2021, 6, 30)
    flat = [(at - dt.timedelta(days=k), 100.0) for k in range(420, 35, -5)]
    near = dt.date(2021, 5, 28)
    spike = [(dt.date(2021, 6, 10), 900.0)]
    assert momentum_of(spark, flat + [(near, 130.0)] + spike) == pytest.approx([0.3])
    # a 2:1 split halves the price without changing the score; a dividend adds to it
    cut = dt.date(2021, 1, 4)
    halved = [(d, p / 2 if d >= cut else p) for d, p in flat] + [(near, 65.0)]
    assert momentum_of(spark, halved, splits=[(cut, 2.0)]) == pytest.approx([0.3])
    assert momentum_of(spark, flat[:1]) == []
    assert momentum_of(spark, flat[:40] + [(flat[40][0], 0.0)] + flat[41:] + [(near, 130.0)]) == []


def test_momentum_matches_windowed_form(spark):
    rng = random.Random(11)
    at = dt.date(2021, 6, 30)
    days = sorted(rng.sample([at - dt.timedelta(days=k) for k in range(32, 500)], 200))
    px = [(d, rng.uniform(50, 150)) for d in days]
    divs = [(d, rng.uniform(0.1, 1)) for d in rng.sample(days, 12)]
    splits = [(d - dt.timedelta(days=rng.randrange(2)), rng.choice([2.0, 0.5, 3.0])) for d in rng.sample(days, 4)]
    lo = max(d for d in days if d <= dt.date(2020, 6, 30))
    hi = max(d for d in days if d <= dt.date(2021, 5, 30))
    win = [(d, p) for d, p in px if lo <= d <= hi]
    sf = lambda d: math.prod(r for s, r in splits if lo < s <= hi and d < s)
    adj = [(d, p / sf(d)) for d, p in win]
    paid = {}
    for d, a in divs:
        if lo < d <= hi:
            paid[d] = paid.get(d, 0) + a / sf(d)
    tr = 1.0
    for (_, p0), (d, p1) in zip(adj, adj[1:]):
        tr *= (p1 + paid.get(d, 0)) / p0
    assert momentum_of(spark, px, divs, splits) == pytest.approx([tr - 1], rel=1e-12)


def test_events_against_snapshots(spark):
    q1, q2 = dt.date(2020, 3, 31), dt.date(2020, 6, 30)
    log = [("A", q1, "historical"), ("A", q2, "current"), ("B", q1, "historical")]
    log += [("A", dt.date(2020, 5, 1), "removed")]  # still listed: fails
    log += [("C", dt.date(2020, 5, 1), "added")]  # never listed: fails
    log += [("D", dt.date(2020, 4, 2), "added"), ("D", dt.date(2020, 6, 1), "removed")]  # joined and left: passes
    log += [("E", dt.date(2020, 7, 5), "added")]  # after the last snapshot: skipped
    sep = spark.createDataFrame([("A", dt.date(2020, 1, 1)), ("A", dt.date(2020, 12, 31))], "ticker string, date date")
    got = {(r.ticker, r.action) for r in Q.dq_events_vs_snapshots(spark.createDataFrame(log, "ticker string, date date, action string"), sep).collect()}
    assert got == {("A", "removed"), ("C", "added")}


def test_calendar(spark):
    cal = spark.createDataFrame([(day(i),) for i in (0, 1, 2, 5, 6, 7)], "dt date")
    asked = spark.createDataFrame([(day(2),), (day(3),), (day(7),)], "dt date")
    got = {r.dt: r.shifted_dt for r in C.shift_sessions(asked, cal, 2).collect()}
    assert got == {day(2): day(6), day(3): day(6), day(7): None}
    with pytest.raises(ValueError):
        C.shift_sessions(asked, cal, 0)


def random_book(rng, n_days=60, n_assets=4):
    px = {(a, day(i)): rng.uniform(80, 120) for a in range(n_assets) for i in range(n_days)}
    divs = {k: rng.uniform(0.1, 1.0) for k in rng.sample(sorted(px), 25)}
    rebals = {day(i): sorted(rng.sample(range(n_assets), rng.randrange(2, n_assets + 1))) for i in (3, 17, 30, 44)}
    return px, divs, rebals


def walk(px, divs, rebals, capital, cost=lambda q, p, a, d: 0.0):
    """Day-by-day accounting; names left out at a rebalance are sold there."""
    cash, pos, out = capital, {}, {}
    for d in sorted({d for _, d in px}):
        cash += sum(q * divs.get((a, d), 0.0) for a, q in pos.items())
        if d in rebals:
            nav = cash + sum(q * px[(a, d)] for a, q in pos.items())
            target = {a: nav / len(rebals[d]) / px[(a, d)] for a in rebals[d]}
            for a in set(pos) | set(target):
                q = target.get(a, 0.0) - pos.get(a, 0.0)
                cash -= q * px[(a, d)] + cost(q, px[(a, d)], a, d)
            pos = target
        out[d] = cash + sum(q * px[(a, d)] for a, q in pos.items())
    return out


def book_frames(spark, px, divs, rebals):
    bars = spark.createDataFrame([(a, d, p) for (a, d), p in px.items()], "asset_id int, dt date, closeunadj double")
    paid = spark.createDataFrame([(a, d, x) for (a, d), x in divs.items()], "asset_id int, ex_date date, amount_per_share double")
    w = spark.createDataFrame([("c", d, a, 1.0 / len(m)) for d, m in rebals.items() for a in m], "curve_id string, dt date, asset_id int, weight double")
    return bars, paid, w


def test_set_valuation_equals_daily_accounting(spark):
    px, divs, rebals = random_book(random.Random(21))
    bars, paid, w = book_frames(spark, px, divs, rebals)
    got = {r.dt: r.nav for r in P.portfolio_nav(w, bars, paid, capital=1000.0).collect()}
    want = walk(px, divs, rebals, 1000.0)
    assert got.keys() == want.keys()
    assert all(got[d] == pytest.approx(want[d], rel=1e-12) for d in want)


def test_costed_valuation_equals_sequential_fold(spark):
    rng = random.Random(22)
    px, divs, rebals = random_book(rng)
    state = {(a, d): (rng.uniform(0.005, 0.03), rng.uniform(50, 200), 1e5) for a, d in px}

    def cost(q, p, a, d):
        s, v, _ = state[(a, d)]
        return abs(q) * p * 0.142 * s * (abs(q) / v) ** 0.6 + abs(q) * 0.01

    bars, paid, w = book_frames(spark, px, divs, rebals)
    ms = spark.createDataFrame([(a, d, *x) for (a, d), x in state.items()], "asset_id int, dt date, sigma_d double, v_d double, theta double")
    got = {r.dt: r.nav for r in P.portfolio_nav_costed(w, bars, paid, ms, capital=1000.0, commission_per_share=0.01).collect()}
    want = walk(px, divs, rebals, 1000.0, cost)
    assert all(got[d] == pytest.approx(want[d], rel=1e-10) for d in want)
    free = {r.dt: r.nav for r in P.portfolio_nav_costed(w, bars, paid, ms, capital=1000.0, eta=0.0).collect()}
    zero = walk(px, divs, rebals, 1000.0)
    assert all(free[d] == pytest.approx(zero[d], rel=1e-12) for d in zero)


@pytest.mark.parametrize("ranged", [1 << 18, 4])
@pytest.mark.parametrize("marked", [True, False])
def test_impacted_valuation_equals_sequential_fold(spark, marked, ranged):
    rng = random.Random(24)
    px, divs, rebals = random_book(rng)
    state = {k: (rng.uniform(0.005, 0.03), rng.uniform(50, 200), 1e4) for k in px}
    cash, pos, reg, want = 1000.0, {}, {}, {}
    for d in sorted({d for _, d in px}):
        cash += sum(q * divs.get((a, d), 0.0) for a, q in pos.items())
        if d in rebals:
            nav = cash + sum(q * px[(a, d)] for a, q in pos.items())
            target = {a: nav / len(rebals[d]) / px[(a, d)] for a in rebals[d]}
            for a in set(pos) | set(target):
                q = target.get(a, 0.0) - pos.get(a, 0.0)
                s, v, th = state[(a, d)]
                sign = (q > 0) - (q < 0)
                temp, perm = 0.142 * s * (abs(q) / v) ** 0.6, 0.5 * 0.314 * s * (abs(q) / v) * (th / v) ** 0.25
                fill = (px[(a, d)] + reg.get(a, 0.0)) * (1 + sign * temp)
                cash -= q * fill
                reg[a] = reg.get(a, 0.0) + sign * perm * fill
            pos = target
        want[d] = cash + sum(q * (px[(a, d)] + (reg.get(a, 0.0) if marked else 0.0)) for a, q in pos.items())
    bars, paid, w = book_frames(spark, px, divs, rebals)
    ms = spark.createDataFrame([(a, d, *x) for (a, d), x in state.items()], "asset_id int, dt date, sigma_d double, v_d double, theta double")
    nav = P.portfolio_nav_costed(w, bars, paid, ms, capital=1000.0, impact_on_prices=True, mark_impact=marked, trades_per_range=ranged)
    got = {r.dt: r.nav for r in nav.collect()}
    assert all(got[d] == pytest.approx(want[d], rel=1e-10) for d in want)


def test_impact_feedback_equals_sequential_rule(spark):
    rng = random.Random(23)
    rows = [(1, day(i), rng.choice([-1, 1]) * rng.uniform(10, 90), rng.uniform(90, 110), rng.uniform(1, 40), rng.uniform(1, 30)) for i in range(25)]
    df = spark.createDataFrame(rows, "asset_id int, dt date, shares double, arrival double, temporary_impact_bps double, permanent_impact_bps double")
    got = CO.impact_feedback(df).orderBy("dt").collect()
    c = 0.0
    for r, (_, _, q, a, t, p) in zip(got, rows):
        sign = 1 if q > 0 else -1
        fill = (a + c) * (1 + sign * t / 1e4)
        assert r.fill_price == pytest.approx(fill, rel=1e-12)
        c += sign * p / 1e4 * fill
        assert r.impact_after == pytest.approx(c, rel=1e-9)


def test_top_quantile_ties_and_floor(spark):
    rows = [(day(0), a, 1.0) for a in range(12)] + [(day(1), 3, 5.0), (day(1), 4, 6.0)]
    got = P.top_quantile(spark.createDataFrame(rows, "dt date, asset_id int, score double")).collect()
    assert sorted((r.dt, r.asset_id, r.weight) for r in got) == [(day(0), 0, 1 / 3), (day(0), 1, 1 / 3), (day(0), 2, 1 / 3), (day(1), 4, 1.0)]


def test_scenarios(spark):
    with pytest.raises(ValueError):
        S.with_scenarios(spark.range(1), "eta", [])
    runs = spark.createDataFrame([(0.1, 10.0), (0.2, 30.0), (0.3, 60.0)], "eta double, final_pnl double")
    got = {r.eta: (r.delta_bps_vs_central, r.min_pnl, r.max_pnl) for r in S.sensitivity_band(runs, param="eta", central=0.2, capital=1000.0).collect()}
    assert got[0.1] == (pytest.approx(-200), 10.0, 60.0) and got[0.3][0] == pytest.approx(300)


def test_trials(spark, tmp_path):
    rows = [("d", "f", 0.1, 60, 0.0, 3.0, '{"a":1}'), ("d", "f", 0.3, 60, 0.0, 3.0, "{}"), ("", "f", 0.1, 60, 0.0, 3.0, "{}"), ("d", "g", float("nan"), 60, 0.0, 3.0, "{}")]
    schema = "dataset_fingerprint string, strategy_family string, sr_hat double, t_observations int, gamma_3 double, gamma_4 double, metadata string"
    T.record_trials(spark.createDataFrame(rows, schema), str(tmp_path / "log"), str(tmp_path / "bad"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2 and {r.status for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"no_fingerprint", "not_finite"}
    got = one(T.trial_variance(log, declared_n=30))
    assert (got.n_recorded, got.n_trials, got.status) == (2, 30, "ok") and got.v_sr == pytest.approx(0.02)


def test_unranked_splits_equal_the_listed_choices(spark):
    for n, k in ((2, 1), (6, 2), (7, 3), (9, 8), (10, 5)):
        got = [tuple(r.groups) for r in CV.split_table(spark, n, k).orderBy("split_id").collect()]
        assert got == CV.combinations(n, k)
    assert CV.split_groups(spark, 20, 10).filter("split_id >= 184750").groupBy("split_id").count().count() == 6
    obs = spark.createDataFrame([(day(i), day(i + 2)) for i in range(40)], "dt date, label_end date")
    wide = CV.cpcv_splits(obs, n_groups=20, k_test=10)
    assert len(wide._jdf.queryExecution().executedPlan().toString()) < 200_000
    with pytest.raises(ValueError):
        CV.split_table(spark, 60, 30)


def test_blocks_give_the_moments_of_written_out_paths(spark):
    from tempora.operators import resample as RS
    rng = random.Random(31)
    rows = [("a", i, rng.gauss(0.001, 0.02)) for i in range(150)] + [("b", i, 0.5) for i in range(40)] + [("c", 0, 1.0)]
    series = spark.createDataFrame(rows, "curve_id string, idx long, r double")
    args = dict(keys=["curve_id"], n_paths=25, block_length=6.0, seed=3)
    paths = RS.stationary_bootstrap(series, value="r", **args)
    want = {(r.curve_id, r.path): r for r in paths.groupBy("curve_id", "path").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s")).collect()}
    got = {(r.curve_id, r.path): r for r in RS.path_moments(series, RS.bootstrap_blocks(series, **args), keys=["curve_id"], value="r").collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k].n == w.n and got[k].mean == pytest.approx(w.m, rel=1e-9, abs=1e-12)
        assert (got[k].std is None) == (w.s is None) and (w.s is None or got[k].std == pytest.approx(w.s, rel=1e-8, abs=1e-12))
    one_way = {r.curve_id: r for r in RS.bootstrap_sharpe(paths, series, keys=["curve_id"], value="r").collect()}
    other = {r.curve_id: r for r in RS.bootstrap_sharpe_blocks(series, value="r", **args).collect()}
    for k, w in one_way.items():
        assert (other[k].p5, other[k].p50, other[k].p95) == pytest.approx((w.p5, w.p50, w.p95), rel=1e-8, abs=1e-12)


def test_autocorrelation_by_blocks_equals_plain_sums(spark):
    from tempora.operators import resample as RS
    rng = random.Random(32)
    rows = [("a", i, rng.gauss(0, 1)) for i in range(77)] + [("b", i, 2.0) for i in range(9)] + [("c", i, float(i % 3)) for i in range(4)]
    series = spark.createDataFrame(rows, "k string, idx long, r double")
    got = {(r.k, r.lag): (r.acf, r.n) for r in RS.autocorrelation(series, keys=["k"], value="r", max_lag=6, rows_per_block=10).collect()}
    for k in "abc":
        x = [r for kk, _, r in rows if kk == k]
        m = sum(x) / len(x)
        v = sum((a - m) ** 2 for a in x)
        for lag in range(1, 7):
            want = sum((x[i] - m) * (x[i + lag] - m) for i in range(len(x) - lag)) / v if v > 0 and len(x) > lag else 0.0
            assert got[(k, lag)] == (pytest.approx(want, abs=1e-12), len(x))
    plan = RS.autocorrelation(series, keys=["k"], value="r", max_lag=6)._jdf.queryExecution().executedPlan().toString()
    assert "idx" not in "".join(line for line in plan.splitlines() if "Join" in line)
