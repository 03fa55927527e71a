"""As-of joins, intervals, running scans and ranks against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tempora.plans.asof import asof_join
from tempora.plans.intervals import active_at, interval_join
from tempora.plans.ranks import kth_smallest, ranked
from tempora.plans.running import BLOCK, RANGES, auto_block, in_ranges, islands, rolling, running

D0 = dt.date(2020, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("block", ["auto", "days"])
def test_asof_matches_brute_force(spark, direction, inclusive, block):
    rng = random.Random(3)
    left = [(rng.randrange(3), day(rng.randrange(60)), i) for i in range(80)]
    right = [(rng.randrange(3), day(rng.randrange(60)), rng.randrange(5), rng.choice([None, rng.random()])) for i in range(60)]
    right = list({(r[0], r[1], r[2]): r for r in right}.values())
    L = spark.createDataFrame(left, "k int, t date, i int")
    R = spark.createDataFrame(right, "k int, u date, tie int, v double")
    how = F.floor(F.datediff("__ts", F.lit(D0)) / 7) if block == "days" else "auto"
    got = asof_join(
        L, R, by=["k"], left_ts="t", right_ts="u", payload=["tie", "v"], tie_break=["tie"], direction=direction, inclusive=inclusive,
        block=how, matched="hit",
    ).collect()
    assert len(got) == len(left)
    for row in got:
        fits = [r for r in right if r[0] == row.k and (
            (r[1] <= row.t if inclusive else r[1] < row.t) if direction == "backward" else (r[1] >= row.t if inclusive else r[1] > row.t))]
        if not fits:
            assert (row.hit, row.tie, row.v) == (False, None, None)
            continue
        best = max(fits, key=lambda r: ((r[1] - D0).days * (1 if direction == "backward" else -1), r[2]))
        assert (row.hit, row.tie, row.v) == (True, best[2], best[3])


def test_asof_later_rows_never_change_the_answer(spark):
    L = spark.createDataFrame([(1, day(10))], "k int, t date")
    R = spark.createDataFrame([(1, day(9), 1.0)], "k int, u date, v double")
    later = spark.createDataFrame([(1, day(11), 9.0), (1, day(40), 8.0)], "k int, u date, v double")
    args = dict(by=["k"], left_ts="t", right_ts="u", payload=["v"])
    assert asof_join(L, R, **args).collect() == asof_join(L, R.unionByName(later), **args).collect()


@pytest.mark.parametrize("bin_days", [None, 1, 7, 64])
def test_interval_join_does_not_depend_on_bins(spark, bin_days):
    rng = random.Random(5)
    pts = spark.createDataFrame([(rng.randrange(3), day(rng.randrange(200)), i) for i in range(60)], "k int, t date, i int")
    spans = [(rng.randrange(3), a := rng.randrange(200), a + rng.randrange(-2, 90), j) for j in range(30)]
    iv = spark.createDataFrame([(k, day(a), day(b), j) for k, a, b, j in spans], "k int, s date, e date, j int")
    got = {(r.i, r.j) for r in interval_join(pts, iv, by=["k"], at="t", start="s", end="e", bin_days=bin_days).collect()}
    want = {(r.i, q.j) for r in pts.collect() for q in iv.collect() if r.k == q.k and q.s <= r.t <= q.e}
    assert got == want


def test_active_at_counts_overlaps(spark):
    rng = random.Random(6)
    spans = [(rng.randrange(3), rng.choice([None, rng.randrange(50)]), rng.choice([None, rng.randrange(20, 80)]), j) for j in range(12)]
    iv = spark.createDataFrame([(k, None if a is None else day(a), None if b is None else day(b), j) for k, a, b, j in spans], "k int, s date, e date, j int")
    pts = spark.createDataFrame([(k, day(d)) for k in range(3) for d in range(0, 90, 3)] * 2, "k int, t date")
    for r in active_at(pts, iv, by=["k"], at="t", start="s", end="e", ident="j").collect():
        on = [j for k, a, b, j in spans if k == r.k and a is not None and day(a) <= r.t and (b is None or r.t <= day(b))]
        assert r.n_active == len(on)
        assert r.active_id == (on[0] if len(on) == 1 else None)


OPS = {
    "s": ("sum", "v"), "n": ("count", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "p": ("product", "v"), "l": ("last", "v"), "g": ("lag", "v")
}


@pytest.mark.parametrize("exclusive", [True, False])
@pytest.mark.parametrize("descending", [True, False])
def test_blocked_scan_equals_plain_scan(spark, exclusive, descending):
    rng = random.Random(7)
    rows = [(rng.randrange(2), i, rng.choice([None, rng.uniform(0.5, 1.5)])) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, t int, v double")
    args = dict(keys=["k"], order=["t"], exprs=OPS, exclusive=exclusive, descending=descending)
    plain = {(r.k, r.t): r for r in running(df, **args).collect()}
    for r in running(df, block=F.floor(F.col("t") / 9), **args).collect():
        want = plain[(r.k, r.t)]
        for c in OPS:
            assert (r[c] is None) == (want[c] is None), c
            if r[c] is not None:
                assert r[c] == pytest.approx(want[c], rel=1e-12), c


def test_blocked_rolling_and_islands_equal_plain(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.randrange(2), i, rng.random(), rng.randrange(2)) for i in range(150)], "k int, t int, v double, f int")
    block = F.floor(F.col("t") / 11)
    args = dict(keys=["k"], order=["t"], exprs={"m": (F.avg("v"), F.col("v"))}, window=7)
    a = {(r.k, r.t): r.m for r in rolling(df, **args).collect()}
    b = {(r.k, r.t): r.m for r in rolling(df, block=block, rows_per_block=8, **args).collect()}
    assert a.keys() == b.keys() and all((a[x] is None) == (b[x] is None) and (a[x] is None or abs(a[x] - b[x]) < 1e-12) for x in a)
    i = {(r.k, r.t): r.run_id for r in islands(df, keys=["k"], order=["t"], flag=F.col("f")).collect()}
    j = {(r.k, r.t): r.run_id for r in islands(df, keys=["k"], order=["t"], flag=F.col("f"), block=block).collect()}
    assert i == j


def test_ranks_in_slices_are_exact(spark):
    rng = random.Random(9)
    rows = [(0, rng.choice([1.0, 2.0, rng.random()]), i) for i in range(5000)] + [(1, float(i % 3), i) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, v double, i int").repartition(5)
    got = {(r.k, r.i): r["rank"] for r in ranked(df, keys=["k"], order=["v", "i"], slices=50).collect()}
    for k in (0, 1):
        order = sorted((v, i) for kk, v, i in rows if kk == k)
        assert all(got[(k, i)] == n for n, (_, i) in enumerate(order, 1))
    ks = spark.createDataFrame([(0, 1), (0, 2500), (0, 5000), (1, 20), (1, 41)], "k int, q bigint")
    out = {(r.k, r.q): r.value_at_k for r in kth_smallest(df, ks, keys=["k"], value="v", k="q", slices=50).collect()}
    vals = sorted(v for k, v, _ in rows if k == 0)
    assert [out[(0, q)] for q in (1, 2500, 5000)] == [vals[0], vals[2499], vals[4999]]
    assert out[(1, 20)] == 1.0 and out[(1, 41)] is None


def test_slices_split_a_hot_group(spark):
    from tempora.plans.ranks import with_slices

    df = spark.range(20000).select(F.lit(0).alias("k"), (F.col("id") % 7).cast("double").alias("v"), F.col("id").alias("i"))
    sizes = [r["count"] for r in with_slices(df, keys=["k"], order=["v", "i"], slices=20).groupBy("__slice").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3000


def test_plans_have_no_nested_loops_and_push_filters(spark):
    from tempora.catalog.views import Views
    from tempora.operators.facts import asof_facts
    from tempora.operators.identity import resolve_ticker
    from tempora.sources.scan import day_bounds

    v = Views(spark, "/root/testdata/sf0.001")
    for df in (asof_facts(v.requests, v.facts, ["revenue"]), resolve_ticker(v.requests, v.securities)):
        text = plan_of(df)
        assert "NestedLoop" not in text and "Cartesian" not in text
    scan = plan_of(day_bounds(v.table("lineitem"), "l_shipdate", "1997-01-01", "1997-12-31").select("l_suppkey"))
    assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThan(l_shipdate" in scan
    assert "ReadSchema: struct<l_suppkey:bigint,l_shipdate" in scan


def test_timestamps_get_a_block_and_dates_do_not(spark):
    df = spark.sql("select date'2020-01-01' d, timestamp'2020-01-01 00:00:00' t")
    assert auto_block(df, "d") is None and auto_block(df, "t") == RANGES and auto_block(df, "d", []) == RANGES


@pytest.mark.parametrize("kind", ["int", "string", "double", "timestamp", "date"])
@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_on_any_order_type_with_a_hot_key(spark, kind, keys, direction):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(12)
    at = lambda n: {"int": n, "string": f"{n:06d}", "double": n / 7, "timestamp": dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n), "date": day(n)}[kind]
    left = [(0 if rng.random() < 0.9 else rng.randrange(1, 4), n := rng.randrange(900), at(n), i) for i in range(600)]
    right = [(k, n, at(n), n + k) for k in range(4 if keys else 1) for n in range(k, 900, 13)]
    L = spark.createDataFrame(left, f"k int, n int, t {kind}, i int")
    R = spark.createDataFrame(right, f"k int, n int, u {kind}, v int").drop("n")
    got = asof_join(L, R, by=keys, left_ts="t", right_ts="u", payload=["v"], direction=direction, block=RANGES).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(left)
    for r in got:
        fits = [x for x in right if (not keys or x[0] == r.k) and (x[1] <= r.n if direction == "backward" else x[1] >= r.n)]
        best = (max if direction == "backward" else min)(fits, key=lambda x: x[1], default=None)
        assert r.v == (best[3] if best else None)


def test_ranges_split_a_hot_key_evenly(spark):
    """One key has 90 percent of the rows, most of them within one week."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(40000).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 97 + 1).alias("k"), F.timestamp_seconds(F.when(F.col("id") % 5 > 0, F.col("id")).otherwise(F.col("id") * 1000)).alias("t"))
    sizes = [r["count"] for r in in_ranges(df, ["k"], ["t"]).groupBy(BLOCK).count().collect()]
    out = running(df, keys=["k"], order=["t"], exprs={"n": ("count", F.lit(1)), "before": ("lag", "t")}, block=RANGES)
    worst = out.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("m"), F.count(F.when(F.col("before").isNull(), 1)).alias("f")).filter("c <> m or f <> 1").count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) <= 1.5 * 40000 / len(sizes) and worst == 0
