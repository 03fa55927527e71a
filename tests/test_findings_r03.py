"""Cases of the third review: each failed before its finding was mended."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
D = dt.date(2020, 1, 1)


def test_equal_holdings_that_differ_in_their_last_bits_are_no_trade(spark, monkeypatch):
    """F1: weights are quotients of sums, so an unchanged holding may be 0.1 + 0.2 one month and 0.3 the next."""
    from tempora.catalog import portfolio as C

    rows = [("top", D, 1, 0.1 + 0.2), ("top", D + dt.timedelta(days=31), 1, 0.3), ("top", D, 2, 5.0), ("top", D + dt.timedelta(days=62), 2, 5.000001)]
    shares = spark.createDataFrame(rows, "curve_id string, dt date, asset_id long, shares double")
    monkeypatch.setattr(C, "share_targets", lambda v: shares)
    name = "rebalance_trades_keep_dropped"
    got = sorted((str(r.dt), r.asset_id, round(r.quantity, 6)) for r in C.QUERIES[name](None).collect())
    assert got == [("2020-01-01", 1, 0.3), ("2020-01-01", 2, 5.0), ("2020-03-03", 2, 0.000001)]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    con.execute("CREATE TABLE held (curve_id VARCHAR, dt DATE, asset_id BIGINT, shares DOUBLE)")
    con.executemany("INSERT INTO held VALUES (?, ?, ?, ?)", rows)
    theirs = con.sql(C.ORACLE[name].replace(C.SHARES, "held")).fetchall()
    assert sorted((d, a, q) for _, d, a, q in theirs) == got


def test_scan_table_returns_every_bar(spark):
    """the query and its SQL had left out bars of less than 20 shares."""
    from tempora.catalog import load

    queries, oracle = load()
    got = queries["scan_table"](spark, SF)
    days = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", F.to_date("l_shipdate").alias("dt")).distinct().count()
    assert got.count() == days and got.filter("volume < 20").count() > 0
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    assert con.sql(f"SELECT count(*) FROM ({oracle['scan_table']})").fetchall() == [(days,)]


def test_filters_on_a_renamed_scan_reach_the_files(spark, tmp_path):
    from tempora.sources import scan as S

    spark.createDataFrame([("A", D, 10), ("B", D, 30)], "symbol string, day date, volume long").write.parquet(str(tmp_path / "b" / "sep.parquet"))
    df = S.scan_table(spark, str(tmp_path), "sep", bundle="b", rename={"symbol": "ticker", "day": "date"}, filters=[F.col("ticker") == "B", F.col("volume") >= 20])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(symbol,B)" in plan and "GreaterThanOrEqual(volume,20)" in plan and [r.ticker for r in df.collect()] == ["B"]


def test_a_book_keeps_bars_and_not_days(spark):
    """F6 to F9: prices were written for every session of every asset, in as few tasks as their packed size asked for."""
    from tempora.operators import portfolio as P

    days = [D + dt.timedelta(days=i) for i in range(40)]
    bars = spark.createDataFrame([(1, d, 10.0 + i) for i, d in enumerate(days)] + [(2, days[0], 5.0), (2, days[30], 6.0)], "asset_id long, dt date, closeunadj double")
    weights = spark.createDataFrame([("c", days[0], 1, 0.5), ("c", days[0], 2, 0.5), ("c", days[20], 1, 1.0)], "curve_id string, dt date, asset_id long, weight double")
    book = P.Book(weights, bars, None, ["curve_id"], "closeunadj")
    assert book.prices.count() == 42
    assert {(r.asset_id, r.bar_dt, r.until) for r in book.lines.filter("asset_id = 2").collect()} == {(2, days[0], days[20])}
    assert "REPARTITION_BY_NUM" in P.carried_prices(bars, None, days[-1], price="closeunadj")._jdf.queryExecution().executedPlan().toString()
    nav = {r.dt: r.nav for r in P.portfolio_nav(weights, bars, None, capital=100.0).collect()}
    assert nav[days[10]] == 100.0 * (0.5 * 20.0 / 10.0 + 0.5) and nav[days[39]] == nav[days[20]] * 49.0 / 30.0


def test_a_band_reads_its_runs_once(spark):
    """the summary, and the valuation behind it, was worked out three times."""
    from tempora.operators.scenarios import sensitivity_band

    runs = spark.range(10).select((F.col("id") % 2).alias("curve_id"), (F.floor(F.col("id") / 2) / 10).alias("eta"), F.col("id").cast("double").alias("final_pnl"))
    band = sensitivity_band(runs, param="eta", central=0.2, capital=1000.0, keys=["curve_id"])
    assert "Range (" not in band._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, band.collect()))[0] == (0, 0.0, 0.0, -40.0, 0.0, 8.0)


def test_only_bars_of_last_days_are_counted_for_proceeds(spark):
    """every bar was grouped by ticker and day to find those of the delisted assets' last days."""
    from tempora.operators.actions import delisting_proceeds

    securities = spark.createDataFrame([(1, "A", "Y", D), (2, "B", "N", None), (3, "C", "Y", D)], "permaticker long, ticker string, isdelisted string, lastpricedate date")
    bars = spark.createDataFrame([("A", D, 4.0), ("A", D - dt.timedelta(days=1), 3.0), ("B", D, 5.0)], "ticker string, dt date, closeunadj double")
    out = delisting_proceeds(securities, bars)
    assert "LeftSemi" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.asset_id, r.amount, r.status) for r in out.collect()) == [(1, 4.0, "ok"), (3, None, "missing_bar")]


def test_a_rolling_frame_is_merged_and_not_added_up_anew(spark):
    """every row added up its whole frame; frames of missing, equal and infinite values keep the values of plain frames."""
    import math
    import random

    from tempora.operators.returns import rolling_market_state
    from tempora.plans.running import rolling, rolling_moments

    rng = random.Random(5)
    value = lambda k, i: None if k == 1 and i % 17 == 3 else 7.1 if k == 2 else math.inf if k == 3 and i == 15 else rng.uniform(-1, 1) * 10 ** rng.randint(-3, 6)
    rows = [(k, D + dt.timedelta(days=i), value(k, i), i * 3 + k) for k in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, t date, x double, n long").repartition(3)
    for window in (1, 2, 7, 20):
        for past in (True, False):
            args = dict(keys=["k"], order=["t"], window=window, exclude_current=past)
            plain = rolling(df, exprs={"a": (F.avg("n"), F.col("n")), "s": (F.stddev_pop("x"), F.col("x"))}, **args).collect()
            got = {(r.k, r.t): r for r in rolling_moments(df, exprs={"a": ("avg", "n"), "s": ("stddev_pop", "x")}, **args).collect()}
            assert len(plain) == len(got) == 300
            for want in plain:
                r = got[want.k, want.t]
                assert r.x == want.x and r.a == want.a
                same = r.s == want.s or (r.s is not None and want.s is not None and (math.isnan(r.s) and math.isnan(want.s) or math.isclose(r.s, want.s, rel_tol=1e-9, abs_tol=1e-12)))
                assert same, (window, past, r, want)
                assert want.k != 2 or r.s in (None, 0.0)
    state = rolling_market_state(df.select("k", F.col("t").alias("dt"), F.col("x").alias("closeunadj"), F.col("n").alias("volume")), keys=["k"])
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "stddev_pop" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_bars_of_a_task_are_written_in_order(spark):
    """three scans by asset each sorted daily rows that lay in the order of their hashes."""
    from tempora.catalog.views import Views, _cents

    daily = Views(spark, SF).daily
    at = daily.select("asset_id", "dt", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()
    assert all((a.asset_id, a.dt) < (b.asset_id, b.dt) for a, b in zip(at, at[1:]) if a.f == b.f)
    values = [0.07, 0.125, -0.125, 0.29, 1.005, -0.005, 0.004999999999999999, 123456789.015, 0.0, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(_cents("v").alias("c"), F.round(F.col("v") * 100).cast("long").alias("w")).collect()
    assert [r.c for r in got] == [r.w for r in got]
