"""Scans, manifests, sinks and streams on temporary files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tempora.plans.status import enforce, validate_or_raise
from tempora.sources import manifest as M
from tempora.sources import scan as S
from tempora.sources.sinks import write_curves, write_metrics
from tempora.streaming.checks import stream_duplicates, stream_lookahead, write_violations

D = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("root")
    rows = [("A", D + dt.timedelta(days=i), 1.0, 2.0, 0.5, 1.5, 1.5, 10) for i in range(10)]
    sep = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, closeunadj double, volume bigint")
    # vendors may ship timestamps instead of dates
    sep.withColumn("date", F.col("date").cast("timestamp")).write.parquet(str(root / "daily_2024-01-01" / "sep.parquet"))
    return str(root)


def test_scan_table(spark, bundle):
    with pytest.raises(KeyError):
        S.scan_table(spark, bundle, "prices")
    with pytest.raises(FileNotFoundError):
        S.scan_table(spark, bundle, "sf1", bundle="daily_2024-01-01")
    raw = S.scan_table(spark, bundle, "sep", bundle="daily_2024-01-01")
    out = S.scan_prices(raw, ticker="A", start="2020-01-03", end="2020-01-05")
    assert [r.dt for r in out.orderBy("dt").collect()] == [D + dt.timedelta(days=i) for i in (2, 3, 4)]
    assert "PushedFilters: [IsNotNull(ticker), IsNotNull(date), EqualTo(ticker,A), GreaterThanOrEqual(date" in out._jdf.queryExecution().executedPlan().toString().replace(
        "IsNotNull(date), IsNotNull(ticker)", "IsNotNull(ticker), IsNotNull(date)")


def test_restated_dimensions_are_refused(spark):
    with pytest.raises(ValueError):
        S.as_reported("MRQ")
    assert S.as_reported("arq") == "ARQ"


def test_manifest_round_trip(spark, bundle, tmp_path):
    prints = M.fingerprint_files(spark, bundle)
    assert {(r.bundle, r.file.split("/")[0]) for r in prints.collect()} == {("daily_2024-01-01", "sep.parquet")}
    path = str(tmp_path / "manifest")
    M.write_manifest(prints, path, pull_date="2024-01-01", source="vendor")
    M.write_manifest(prints.withColumn("bundle", F.lit("daily_2024-02-01")), path, pull_date="2024-02-01", source="vendor")
    M.write_manifest(prints.withColumn("bundle", F.lit("daily_2024-02-01")), path, pull_date="2024-02-02", source="vendor")
    manifest = spark.read.parquet(path)
    assert manifest.count() == 2 * prints.count()
    assert M.latest_bundle(manifest, "daily").first().bundle == "daily_2024-02-01"
    assert M.validate_manifest(manifest).count() == 0
    mine = manifest.filter("bundle = 'daily_2024-01-01'")
    here = prints
    assert {tuple(r) for r in M.available_tables(mine).collect()} == {("daily_2024-01-01", "sep")}
    assert M.verify_bundle(here, mine).count() == 0
    changed = here.withColumn("sha256", F.lit("0" * 64))
    assert {r.violation for r in M.verify_bundle(changed, mine).collect()} == {"sha_mismatch"}
    assert {r.violation for r in M.verify_bundle(here.limit(0), mine).collect()} == {"missing"}
    assert prints.agg(F.sum("row_count")).first()[0] == 10


def test_concat_and_strict(spark):
    with pytest.raises(ValueError):
        S.concat_batches([spark.range(0)], require_rows=True)
    bad = spark.range(1).withColumn("status", F.lit("ambiguous"))
    with pytest.raises(Exception, match="ambiguous"):
        enforce(bad, strict=True, context="resolve").collect()
    with pytest.raises(ValueError):
        validate_or_raise(bad, "found")


def test_files_above_two_gigabytes_are_hashed_in_blocks(spark, tmp_path):
    import hashlib
    (tmp_path / "daily_1").mkdir()
    with open(tmp_path / "daily_1" / "big.csv", "wb") as f:
        f.truncate((2 << 30) + 12345)
        f.seek(1 << 30)
        f.write(b"middle")
    (tmp_path / "daily_1" / "a b.csv").write_bytes(b"x,y")
    (tmp_path / "daily_1" / "note.txt").write_bytes(b"-")
    state = hashlib.sha256()
    with open(tmp_path / "daily_1" / "big.csv", "rb") as f:
        while block := f.read(1 << 24):
            state.update(block)
    got = {r.file: r for r in M.fingerprint_files(spark, str(tmp_path)).collect()}
    assert got.keys() == {"big.csv", "a b.csv"}
    assert (got["big.csv"].sha256, got["big.csv"].size_bytes, got["big.csv"].row_count) == (state.hexdigest(), (2 << 30) + 12345, None)
    assert got["a b.csv"].sha256 == hashlib.sha256(b"x,y").hexdigest() and {r.bundle for r in got.values()} == {"daily_1"}
    plan = M.list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


@pytest.mark.parametrize("name, filters", [
    ("scan_table", ["GreaterThanOrEqual(volume,20)"]), ("scan_prices", ["EqualTo(symbol,T7)", "GreaterThanOrEqual(day,1996", "LessThan(day,1999"]),
    ("scan_dividends", ["EqualTo(kind,dividend)", "GreaterThanOrEqual(date,1997-03-01"]), ("scan_actions", ["In(kind, [spinoff,split])", "LessThanOrEqual(date,2000-06-30"]),
    ("scan_tickers", ["LessThanOrEqual(first,1999-06-30", "GreaterThanOrEqual(lastpricedate,1999-06-30"]),
    ("scan_fundamentals", ["EqualTo(dimension,ART)", "GreaterThanOrEqual(filed,1996-01-01"]), ("scan_membership", ["EqualTo(change,added)", "GreaterThanOrEqual(day,1996-01-01"]),
])
def test_filters_on_declared_names_reach_the_files(spark, name, filters):
    from tempora.catalog import load
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = load()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: ", 1)[1].split("ReadSchema", 1)[0]
    assert all(f in pushed for f in filters), pushed
    assert plan.count("Scan parquet") == 1 and "daily_2024-01-01" in plan


def test_renamed_columns_must_exist(spark, bundle):
    with pytest.raises(KeyError):
        S.scan_table(spark, bundle, "sep", bundle="daily_2024-01-01", rename={"symbol": "ticker"})


def test_reference_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("period,annualized_nav_tr_pct,annualized_market_price_tr_pct\n1Y,12.5,12.4\n3y,-,\n1y,1,1\n")
    got = {(r.period, r.annualized_nav_tr, r.status) for r in S.scan_reference_performance(spark, str(tmp_path / "p.csv")).collect()}
    assert got == {("1y", 0.125, "duplicate"), ("1y", 0.01, "duplicate"), ("3y", None, "ok")}
    (tmp_path / "d.csv").write_text("ex_date,amount_per_share\n2024-03-15,1.59\n")
    assert [tuple(r) for r in S.scan_reference_distributions(spark, str(tmp_path / "d.csv")).collect()] == [(dt.date(2024, 3, 15), 1.59)]


def test_sinks_plan_their_files(spark, tmp_path):
    days = [("hot" if i % 3 else f"c{i % 7}", D + dt.timedelta(days=i % 700), float(i)) for i in range(6000)]
    curves = spark.createDataFrame(days, "curve_id string, dt date, nav double")
    assert write_curves(curves, str(tmp_path / "c"), rows_per_file=1000) == 6
    files = [p for p in (tmp_path / "c").rglob("*.parquet")]
    back = spark.read.parquet(str(tmp_path / "c"))
    assert 6 <= len(files) <= 6 + 2 and sorted(map(tuple, back.select("curve_id", "dt", "nav").collect())) == sorted(days)
    assert max(r["count"] for r in back.groupBy(F.input_file_name()).count().collect()) <= 2500
    assert write_metrics(curves.groupBy("curve_id").count(), str(tmp_path / "m")) == 1 and len(list((tmp_path / "m").glob("*.parquet"))) == 1


def test_write_curves(spark, tmp_path):
    c = spark.createDataFrame([("a", D, 1.0), ("a", dt.date(2021, 1, 1), 2.0)], "curve_id string, dt date, nav double")
    write_curves(c, str(tmp_path / "curves"))
    assert spark.read.parquet(str(tmp_path / "curves")).filter("year = 2021").count() == 1


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    ts = lambda m: dt.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([("a", D, D, ts(1)), ("a", D, D, ts(2)), ("b", D + dt.timedelta(days=3), D, ts(3))], "k string, av date, asof date, ts timestamp").write.parquet(src)
    stream = lambda: spark.readStream.schema("k string, av date, asof date, ts timestamp").parquet(src)
    q = write_violations(stream_lookahead(stream(), available="av", asof="asof", context="s"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    q.awaitTermination()
    assert [r.k for r in spark.read.parquet(str(tmp_path / "o1")).collect()] == ["b"]
    dup = stream_duplicates(stream(), keys=["k"], event_time="ts", delay="1 minute", window="10 minutes")
    q = dup.writeStream.format("memory").queryName("dups").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.k, r.n) for r in spark.table("dups").collect()] == [("a", 2)]
