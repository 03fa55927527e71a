"""Registered queries: scans, manifests, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog.present import wrap
from tempora.catalog.view_sql import with_views
from tempora.catalog.views import Views
from tempora.functions.cleaning import clean_date, clean_percent, clean_ticker
from tempora.sources import manifest as M
from tempora.sources import scan as S
from tempora.sources.sinks import write_curves, write_metrics

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None, columns: str = "", digits: int = 6):
    def add(fn):
        fn.digits = digits
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = wrap(with_views(sql), columns, digits) if columns else with_views(sql)
        return fn

    return add


def sep(v: Views):
    return v.bars.drop("asset_id").withColumnRenamed("dt", "date")


def manifest(v: Views):
    """A manifest derived from customer: many bundles, some malformed rows."""
    c = v.table("customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("daily_"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 40).cast("int")).cast("string")).alias("bundle"),
        F.concat(F.lit("part-"), k.cast("string"), F.when(k % 6 == 0, ".csv").otherwise(".parquet")).alias("file"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 40).cast("int")).alias("pull_date"),
        F.when(k % 29 == 0, "zz").otherwise(F.sha2("c_name", 256)).alias("sha256"),
        F.when(k % 31 == 0, -1).otherwise(F.length("c_name") * 100).cast("long").alias("size_bytes"),
        F.when(k % 6 == 0, F.lit(None)).when(k % 37 == 0, -5).otherwise(k).cast("long").alias("row_count"),
    )


MANIFEST_SQL = """
(SELECT 'daily_' || CAST(DATE '2024-01-01' + CAST(c_custkey % 40 AS INTEGER) AS VARCHAR) AS bundle,
  'part-' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 6 = 0 THEN '.csv' ELSE '.parquet' END AS file,
  DATE '2024-01-01' + CAST(c_custkey % 40 AS INTEGER) AS pull_date,
  CASE WHEN c_custkey % 29 = 0 THEN 'zz' ELSE sha256(c_name) END AS sha256,
  CASE WHEN c_custkey % 31 = 0 THEN -1 ELSE length(c_name) * 100 END AS size_bytes,
  CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN -5 ELSE c_custkey END AS row_count FROM customer)"""


@query(
    "scan_table",
    "SELECT ticker, dt AS date, open, high, low, close, closeunadj, volume FROM bars",
    "ticker date:d open:f high:f low:f close:f closeunadj:f volume",
)
def _(v):
    return S.conform(v.vendor("sep"), "sep")


@query(
    "scan_prices",
    "SELECT ticker, dt, open, close, closeunadj, volume FROM bars WHERE ticker = 'T7' AND dt BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'",
    "ticker dt:d open:f close:f closeunadj:f volume",
)
def _(v):
    out = S.scan_prices(v.vendor("sep"), ticker="T7", start="1996-01-01", end="1998-12-31")
    return out.select("ticker", "dt", "open", "close", "closeunadj", "volume")


@query(
    "scan_dividends",
    "SELECT ticker, date AS ex_date, value AS amount_per_share FROM actions WHERE action = 'dividend' AND date >= DATE '1997-03-01'",
    "ticker ex_date:d amount_per_share:f",
)
def _(v):
    return S.scan_dividends(v.vendor("actions"), start="1997-03-01")


@query(
    "scan_actions",
    "SELECT ticker, date, action, value FROM actions WHERE action IN ('split', 'spinoff') AND date <= DATE '2000-06-30'",
    "ticker date:d action value:f",
)
def _(v):
    return S.scan_actions(v.vendor("actions"), end="2000-06-30", allow=["split", "spinoff"])


@query(
    "scan_tickers",
    """SELECT permaticker, ticker, isdelisted, firstpricedate, lastpricedate FROM securities
       WHERE firstpricedate <= DATE '1999-06-30' AND (lastpricedate IS NULL OR lastpricedate >= DATE '1999-06-30')""",
    "permaticker ticker isdelisted firstpricedate:d lastpricedate:d",
)
def _(v):
    return S.scan_tickers(v.vendor("tickers"), active_at="1999-06-30")


@query(
    "scan_fundamentals",
    """SELECT ticker, dimension, calendardate, datekey, revenue, marketcap, sharesbas FROM filings
       WHERE dimension = 'ART' AND datekey >= DATE '1996-01-01'""",
    "ticker dimension calendardate:d datekey:d revenue:f marketcap:f sharesbas:f",
)
def _(v):
    return S.scan_fundamentals(v.vendor("sf1"), dimension="art", start="1996-01-01")


@query(
    "scan_membership",
    "SELECT ticker, date, action FROM membership_log WHERE action = 'added' AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'",
    "ticker date:d action",
)
def _(v):
    return S.scan_membership(v.vendor("sp500"), action="added", start="1996-01-01", end="2000-12-31")


@query(
    "available_tables",
    f"""SELECT DISTINCT bundle, replace(file, '.parquet', '') AS "table" FROM {MANIFEST_SQL} WHERE file LIKE '%.parquet'""",
)
def _(v):
    return M.available_tables(manifest(v))


@query("latest_bundle", f"SELECT max(bundle) AS bundle FROM {MANIFEST_SQL} WHERE starts_with(bundle, 'daily_')")
def _(v):
    return M.latest_bundle(manifest(v), "daily")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("file_row_counts", " UNION ALL ".join(f"""SELECT '{t}.parquet' AS "file", count(*) AS row_count FROM {t}""" for t in TABLES))
def _(v):
    # A table is one file or a folder of part files.
    counts = M.file_row_counts(v.spark, v.sf_dir)
    return counts.groupBy(F.regexp_extract("path", r"/([^/]+\.parquet)(?:/[^/]+)?$", 1).alias("file")).agg(F.sum("row_count").alias("row_count"))


@query("fingerprint_files")
def _(v):
    return M.fingerprint_files(v.spark, v.sf_dir).select("file", "sha256", "size_bytes", "row_count")


@query(
    "verify_bundle",
    f"""SELECT bundle, file, CASE WHEN hs IS NULL THEN 'missing' WHEN hs <> sha256 THEN 'sha_mismatch' ELSE 'size_mismatch' END AS violation
    FROM (SELECT m.*, a.hs, a.hb FROM {MANIFEST_SQL} m LEFT JOIN (
      SELECT bundle, CASE WHEN row_count % 17 = 0 THEN 'moved-' || file ELSE file END AS file, CASE WHEN size_bytes % 700 = 0 THEN 'changed' ELSE sha256 END AS hs,
             CASE WHEN row_count % 11 = 0 THEN size_bytes + 1 ELSE size_bytes END AS hb
      FROM {MANIFEST_SQL}) a ON m.bundle = a.bundle AND m.file = a.file)
    WHERE hs IS NULL OR hs <> sha256 OR hb <> size_bytes""",
)
def _(v):
    want = manifest(v)
    have = want.select(
        "bundle", F.when(F.col("row_count") % 17 == 0, F.concat(F.lit("moved-"), "file")).otherwise(F.col("file")).alias("file"),
        F.when(F.col("size_bytes") % 700 == 0, "changed").otherwise(F.col("sha256")).alias("sha256"),
        F.when(F.col("row_count") % 11 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
    )
    return M.verify_bundle(have, want)


@query(
    "validate_manifest",
    f"""SELECT bundle, file, problem FROM (
      SELECT *, 'sha256_malformed' AS problem FROM {MANIFEST_SQL} WHERE NOT regexp_full_match(sha256, '[0-9a-f]{{64}}')
      UNION ALL SELECT *, 'size_invalid' FROM {MANIFEST_SQL} WHERE size_bytes < 0
      UNION ALL SELECT *, 'row_count_invalid' FROM {MANIFEST_SQL} WHERE row_count < 0)""",
)
def _(v):
    return M.validate_manifest(manifest(v))


@query(
    "freshness",
    f"""SELECT bundle, pull_date, age_days, CASE WHEN age_days < 30 THEN 'ok' WHEN age_days < 90 THEN 'warn' ELSE 'stale' END AS status
    FROM (SELECT DISTINCT bundle, pull_date, CAST(floor(epoch(TIMESTAMP '2024-04-05 12:00:00' - (pull_date + INTERVAL 16 HOUR)) / 86400) AS BIGINT) AS age_days
          FROM {MANIFEST_SQL})""",
    "bundle pull_date:d age_days status",
)
def _(v):
    return M.freshness(manifest(v), "2024-04-05 12:00:00")


@query(
    "missing_bundles",
    f"""SELECT bundle FROM (SELECT DISTINCT 'daily_' || CAST(DATE '2024-01-01' + CAST(c_custkey % 60 AS INTEGER) AS VARCHAR) AS bundle FROM customer)
    WHERE bundle NOT IN (SELECT bundle FROM {MANIFEST_SQL})""",
)
def _(v):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 60).cast("int"))
    asked = v.table("customer").select(F.concat(F.lit("daily_"), day.cast("string")).alias("bundle"))
    return M.missing_bundles(asked, manifest(v))


@query("write_curves", "SELECT curve_id, dt, nav, year(dt) AS year FROM asset_curves", "curve_id dt:d nav:f year:i", 4)
def _(v):
    path = v.folder("curves")
    write_curves(v.asset_curves, path, rows_per_file=20_000)
    return v.spark.read.parquet(path)


@query("write_metrics", "SELECT curve_id, count(*) AS n_days, max(nav) AS top FROM asset_curves GROUP BY 1", "curve_id n_days top:f", 4)
def _(v):
    path = v.folder("metrics")
    write_metrics(v.asset_curves.groupBy("curve_id").agg(F.count(F.lit(1)).alias("n_days"), F.max("nav").alias("top")), path)
    return v.spark.read.parquet(path)


@query("scan_reference_distributions", "SELECT ex_date, amount_per_share FROM dividends", "ex_date:d amount_per_share:f")
def _(v):
    path = v.folder("distributions")
    v.dividends.select("ex_date", "amount_per_share").write.option("header", True).csv(path)
    return S.scan_reference_distributions(v.spark, path)


@query(
    "scan_reference_performance",
    """SELECT period, pct / 100e0 AS annualized_nav_tr, CASE WHEN count(*) OVER (PARTITION BY period) > 1 THEN 'duplicate' ELSE 'ok' END AS status
    FROM (SELECT lower('P' || CAST(c_custkey % 1000 AS VARCHAR)) AS period, c_acctbal / 100e0 AS pct FROM customer WHERE c_custkey % 7 < 5)""",
    "period annualized_nav_tr:f status",
)
def _(v):
    path = v.folder("performance")
    c = v.table("customer").filter(F.col("c_custkey") % 7 < 5)
    c.select(
        F.concat(F.lit("P"), (F.col("c_custkey") % 1000).cast("string")).alias("period"), (F.col("c_acctbal") / 100.0).alias("annualized_nav_tr_pct"),
        F.lit(None).cast("double").alias("annualized_market_price_tr_pct"),
    ).write.option("header", True).csv(path)
    return S.scan_reference_performance(v.spark, path)


def performance_raw(v: Views):
    c = v.table("customer")
    k = F.col("c_custkey")
    period = F.element_at(F.array(*[F.lit(p) for p in ("1Y", "3y", "5Y", "10y", "SI")]), (k % 5 + 1).cast("int"))
    return c.select(
        (F.floor(k / 5)).alias("fund"),
        F.when(k % 53 == 0, "1Y").otherwise(period).alias("period"),
        (F.col("c_acctbal") / 100.0).alias("annualized_nav_tr_pct"),
    )


PERF_SQL = """
(SELECT c_custkey // 5 AS fund, lower(CASE WHEN c_custkey % 53 = 0 THEN '1Y' ELSE ['1Y','3y','5Y','10y','SI'][c_custkey % 5 + 1] END) AS period,
        c_acctbal / 100e0 AS pct FROM customer)"""


@query(
    "reference_performance",
    f"""SELECT fund, period, pct / 100e0 AS annualized_nav_tr, CASE WHEN count(*) OVER (PARTITION BY fund, period) > 1 THEN 'duplicate' ELSE 'ok' END AS status
    FROM {PERF_SQL}""",
    "fund period annualized_nav_tr:f status",
)
def _(v):
    return S.reference_performance(performance_raw(v), keys=["fund"])


@query(
    "reference_for_period",
    f"""SELECT f.fund, f.period, CASE WHEN n = 1 THEN a END AS annualized_nav_tr,
        CASE WHEN n IS NULL THEN 'unknown_period' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS status
    FROM (SELECT DISTINCT fund, '10y' AS period FROM {PERF_SQL} UNION ALL SELECT DISTINCT fund, '1y' FROM {PERF_SQL}) f
    LEFT JOIN (SELECT fund, period, count(*) AS n, max(pct) / 100e0 AS a FROM {PERF_SQL} GROUP BY 1, 2) p
    ON f.fund = p.fund AND f.period = p.period""",
    "fund period annualized_nav_tr:f status",
)
def _(v):
    raw = performance_raw(v)
    asked = raw.select("fund").distinct().select("fund", F.explode(F.array(F.lit("10Y"), F.lit("1y"))).alias("period"))
    return S.reference_for(asked, S.reference_performance(raw, keys=["fund"]), keys=["fund"])


@query(
    "clean_reference_cells",
    """SELECT c_custkey, regexp_extract(trim(raw_t), '^([A-Za-z0-9.]+)', 1) AS ticker,
      TRY_CAST(nullif(trim(regexp_replace(trim(raw_p), '%+$', '')), '-') AS DOUBLE) AS pct, d AS day FROM (
      SELECT c_custkey, ' ' || replace(c_mktsegment, 'E', '.') || '(R) ' AS raw_t,
        CASE WHEN c_custkey % 7 = 0 THEN ' - ' ELSE ' ' || CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) || '.25% ' END AS raw_p,
        CASE WHEN c_custkey % 5 < 4 THEN DATE '2020-01-05' + CAST(c_custkey % 700 AS INTEGER) END AS d FROM customer)""",
    "c_custkey ticker pct:f day:d",
)
def _(v):
    c = v.table("customer")
    k = F.col("c_custkey")
    d = F.date_add(F.lit("2020-01-05").cast("date"), (k % 700).cast("int"))
    spelled = (
        F.when(k % 5 == 0, F.date_format(d, "MMM d yyyy")).when(k % 5 == 1, F.date_format(d, "MMMM d yyyy"))
        .when(k % 5 == 2, F.date_format(d, "MM/dd/yyyy")).when(k % 5 == 3, d.cast("string")).otherwise("n/a")
    )
    raw = c.select(
        "c_custkey",
        F.concat(F.lit(" "), F.replace("c_mktsegment", F.lit("E"), F.lit(".")), F.lit("(R) ")).alias("t"),
        F.when(k % 7 == 0, " - ").otherwise(
            F.concat(F.lit(" "), F.rint("c_acctbal").cast("long").cast("string"), F.lit(".25% "))
        ).alias("p"),
        spelled.alias("d"),
    )
    return raw.select(
        "c_custkey", clean_ticker(F.col("t")).alias("ticker"), clean_percent(F.col("p")).alias("pct"),
        clean_date(F.col("d")).alias("day"),
    )


@query(
    "profile_per_ticker",
    "SELECT ticker, count(*) AS n_rows, min(dt) AS first_day, max(dt) AS last_day FROM bars GROUP BY 1",
    "ticker n_rows first_day:d last_day:d",
)
def _(v):
    return S.profile_table(sep(v))[0]


@query(
    "profile_table",
    "SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_keys, min(dt) AS first_day, max(dt) AS last_day FROM bars",
    "n_rows n_keys first_day:d last_day:d",
)
def _(v):
    return S.profile_table(sep(v))[1]


@query(
    "coverage_staleness",
    "SELECT ticker, max(dt) AS last_day FROM bars GROUP BY 1 HAVING max(dt) < DATE '2001-11-10' - 10",
    "ticker last_day:d",
)
def _(v):
    return S.coverage_staleness(sep(v), requested_end="2001-11-10")


@query(
    "sentinel_staleness",
    """SELECT s.ticker, last_day, CASE WHEN last_day IS NULL THEN 'absent' WHEN last_day < DATE '2001-11-10' - 10 THEN 'stale' ELSE 'ok' END AS status
    FROM (SELECT DISTINCT 'T' || CAST(s_suppkey % 120 AS VARCHAR) AS ticker FROM supplier) s
    LEFT JOIN (SELECT ticker, max(dt) AS last_day FROM bars GROUP BY 1) b ON s.ticker = b.ticker""",
    "ticker last_day:d status",
)
def _(v):
    wanted = v.table("supplier").select(F.concat(F.lit("T"), (F.col("s_suppkey") % 120).cast("string")).alias("ticker"))
    return S.sentinel_staleness(sep(v), wanted, requested_end="2001-11-10")


@query(
    "dedupe_identity",
    """SELECT permaticker, ticker, firstpricedate FROM securities""",
    "permaticker ticker firstpricedate:d",
)
def _(v):
    repeated = v.securities.select("*", F.explode(F.array(F.lit("SEP"), F.lit("SF1"), F.lit("SFP"))).alias("table"))
    return S.dedupe_identity(repeated).select("permaticker", "ticker", "firstpricedate")


@query(
    "concat_batches",
    """SELECT asset_id, dt, close, NULL::BIGINT AS volume FROM bars WHERE asset_id % 2 = 0
       UNION ALL SELECT asset_id, dt, close, volume FROM bars WHERE asset_id % 2 = 1""",
    "asset_id dt:d close:f volume",
)
def _(v):
    even = v.bars.filter(F.col("asset_id") % 2 == 0).select("asset_id", "dt", "close")
    odd = v.bars.filter(F.col("asset_id") % 2 == 1).select("asset_id", "dt", "close", "volume")
    return S.concat_batches([even, odd.filter(F.col("asset_id") < 0), odd])
