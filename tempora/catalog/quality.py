"""Registered queries: data-quality contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog.inputs import sep
from tempora.catalog.present import wrap
from tempora.catalog.view_sql import with_views
from tempora.operators import quality as Q
from tempora.session import materialise

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None, columns: str = ""):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = wrap(with_views(sql), columns) if columns else with_views(sql)
        return fn

    return add


def listings(v):
    """Securities with some starts moved, so that the first-price rule has work."""
    a = F.col("permaticker")
    start = F.when(a % 3 == 1, F.expr("date_add(firstpricedate, 400 + cast(permaticker as int))")).otherwise(F.col("firstpricedate"))
    end = F.when(a % 10 == 0, F.date_sub("lastpricedate", 30)).otherwise(F.col("lastpricedate"))
    return v.securities.withColumn("firstpricedate", start).withColumn("lastpricedate", end).withColumn(
        "ticker", F.when(a % 7 == 3, F.concat(F.lit("X"), a.cast("string"))).otherwise(F.col("ticker"))
    )


LIST = """(SELECT permaticker, CASE WHEN permaticker % 7 = 3 THEN 'X' || CAST(permaticker AS VARCHAR) ELSE ticker END AS ticker, isdelisted,
   CASE WHEN permaticker % 3 = 1 THEN firstpricedate + 400 + CAST(permaticker AS INTEGER) ELSE firstpricedate END AS firstpricedate,
   CASE WHEN permaticker % 10 = 0 THEN lastpricedate - 30 ELSE lastpricedate END AS lastpricedate FROM securities)"""

FIRST = f"""SELECT permaticker, ticker, firstpricedate, lastpricedate FROM (
  SELECT s.*, (SELECT min(c.dt) FROM calendar c WHERE (SELECT count(*) FROM calendar x WHERE x.dt > s.firstpricedate AND x.dt <= c.dt) = 5) AS cutoff
  FROM {LIST} s WHERE firstpricedate >= (SELECT min(dt) FROM bars)) s
  WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = s.ticker AND b.dt >= s.firstpricedate AND b.dt <= coalesce(s.cutoff, DATE '9999-01-01'))"""
AFTER = f"""SELECT permaticker, s.ticker, lastpricedate, b.dt AS sep_date, closeunadj FROM {LIST} s JOIN bars b ON b.ticker = s.ticker
  WHERE isdelisted = 'Y' AND b.dt > lastpricedate"""
NULLKEY = "SELECT ticker, calendardate, dimension FROM filings WHERE dimension = 'ARQ' AND calendardate >= DATE '1991-01-01' AND datekey IS NULL"
DUPFACT = "SELECT ticker, datekey, dimension, count(*) AS n FROM filings GROUP BY 1, 2, 3 HAVING count(*) > 1"
RESOLVE = f"""SELECT m.ticker, coalesce(n, 0) AS n_assets FROM (SELECT DISTINCT ticker FROM membership_log WHERE action IN ('historical', 'current')) m
  LEFT JOIN (SELECT ticker, count(DISTINCT permaticker) AS n FROM {LIST} WHERE firstpricedate IS NOT NULL GROUP BY 1) u ON m.ticker = u.ticker
  WHERE coalesce(n, 0) <> 1"""
DUPEV = "SELECT ticker, date, action, count(*) AS n FROM membership_log GROUP BY 1, 2, 3 HAVING count(*) > 1"
EVENTS = """SELECT ticker, event_date, action, CASE action WHEN 'removed' THEN 'removed but still in next snapshot' ELSE 'added but absent from next snapshot' END AS inconsistency
  FROM (SELECT e.ticker, e.date AS event_date, e.action, (SELECT min(date) FROM membership_log s WHERE s.action IN ('historical', 'current') AND s.date >= e.date) AS snap
        FROM membership_log e WHERE e.action IN ('added', 'removed') AND e.date BETWEEN (SELECT min(dt) FROM bars) AND (SELECT max(dt) FROM bars)) e
  WHERE snap IS NOT NULL
    AND (action = 'removed') = EXISTS (SELECT 1 FROM membership_log s WHERE s.action IN ('historical', 'current') AND s.date = snap AND s.ticker = e.ticker)
    AND NOT EXISTS (SELECT 1 FROM membership_log o WHERE o.ticker = e.ticker AND o.action IN ('added', 'removed') AND o.action <> e.action
                    AND o.date > e.event_date AND o.date <= snap AND o.date BETWEEN (SELECT min(dt) FROM bars) AND (SELECT max(dt) FROM bars))"""


@query("dq_first_price", FIRST, "permaticker ticker firstpricedate:d lastpricedate:d")
def _(v):
    return Q.dq_first_price(listings(v), sep(v))


@query("dq_bars_after_delisting", AFTER, "permaticker ticker lastpricedate:d sep_date:d closeunadj:f")
def _(v):
    return Q.dq_bars_after_delisting(listings(v), sep(v))


@query("dq_null_datekey", NULLKEY, "ticker calendardate:d dimension")
def _(v):
    return Q.dq_null_datekey(v.filings)


@query("dq_duplicate_facts", DUPFACT, "ticker datekey:d dimension n")
def _(v):
    return Q.dq_duplicate_facts(v.filings)


@query("dq_members_resolve", RESOLVE, "ticker n_assets")
def _(v):
    return Q.dq_members_resolve(v.membership_log, listings(v))


@query("dq_duplicate_events", DUPEV, "ticker date:d action n")
def _(v):
    return Q.dq_duplicate_events(v.membership_log)


@query("dq_events_vs_snapshots", EVENTS, "ticker event_date:d action inconsistency")
def _(v):
    return Q.dq_events_vs_snapshots(v.membership_log, sep(v))


def vendor_tables(v):
    derived = {"tickers": listings(v), "sep": sep(v), "sf1": v.filings, "sp500": v.membership_log}
    return {name: materialise(table) for name, table in derived.items()}


@query(
    "run_contracts",
    f"""SELECT 'tickers_first_price_within_five_days' AS contract, (SELECT count(*) FROM ({FIRST})) AS n_violations
    UNION ALL SELECT 'no_sep_bars_after_delisting', (SELECT count(*) FROM ({AFTER}))
    UNION ALL SELECT 'sf1_datekey_non_null_after_1990', (SELECT count(*) FROM ({NULLKEY}))
    UNION ALL SELECT 'no_duplicate_ticker_datekey_in_sf1', (SELECT count(*) FROM ({DUPFACT}))
    UNION ALL SELECT 'sp500_snapshot_members_resolve', (SELECT count(*) FROM ({RESOLVE}))
    UNION ALL SELECT 'no_duplicate_sp500_events', (SELECT count(*) FROM ({DUPEV}))
    UNION ALL SELECT 'sp500_added_removed_consistent_with_snapshots', (SELECT count(*) FROM ({EVENTS}))""",
)
def _(v):
    return Q.run_contracts(vendor_tables(v))[0]


def json_rows(contract: str, sql: str, columns: str) -> str:
    """Rows of `sql` as JSON text without NULL fields; a column name may end in :n for a number."""
    fields = []
    for column in columns.split():
        name, _, number = column.partition(":")
        text = f"CAST({name} AS VARCHAR)"
        fields.append(f"""'"{name}":' || {text if number else f"""'"' || {text} || '"'"""}""")
    return f"SELECT '{contract}' AS contract, '{{' || array_to_string(list_filter([{', '.join(fields)}], lambda x: x IS NOT NULL), ',') || '}}' AS row_json FROM ({sql})"


SAMPLES = " UNION ALL ".join(
    json_rows(*c)
    for c in (
        ("tickers_first_price_within_five_days", FIRST, "permaticker:n ticker firstpricedate lastpricedate"),
        ("no_sep_bars_after_delisting", AFTER, "permaticker:n ticker lastpricedate sep_date closeunadj:n"),
        ("sf1_datekey_non_null_after_1990", NULLKEY, "ticker calendardate dimension"),
        ("no_duplicate_ticker_datekey_in_sf1", DUPFACT, "ticker datekey dimension n:n"),
        ("sp500_snapshot_members_resolve", RESOLVE, "ticker n_assets:n"),
        ("no_duplicate_sp500_events", DUPEV, "ticker date action n:n"),
        ("sp500_added_removed_consistent_with_snapshots", EVENTS, "ticker event_date action inconsistency"),
    )
)


@query(
    "contract_samples",
    f"""SELECT contract, sample_no, row_json FROM (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY row_json) AS sample_no FROM ({SAMPLES}))
    WHERE sample_no <= 10""",
)
def _(v):
    return Q.run_contracts(vendor_tables(v))[1].select("contract", "sample_no", "row_json")


@query(
    "dq_scale",
    "SELECT c_custkey, c_acctbal / 1000e0 AS annualized_return FROM customer WHERE c_acctbal / 1000e0 NOT BETWEEN -1 AND 1",
    "c_custkey annualized_return:f",
)
def _(v):
    return Q.dq_scale(v.table("customer").select("c_custkey", (F.col("c_acctbal") / 1000.0).alias("annualized_return")))


@query(
    "dq_market_state",
    """SELECT asset_id, dt, sigma_d - 0.001e0 AS sigma_d, v_d, theta - 100000e0 AS theta FROM market_state
       WHERE v_d <= 0 OR theta - 100000e0 <= 0 OR sigma_d - 0.001e0 < 0""",
    "asset_id dt:d sigma_d:f v_d:f theta:f",
)
def _(v):
    shifted = v.market_state.withColumn("theta", F.col("theta") - 100000.0).withColumn("sigma_d", F.col("sigma_d") - 0.001)
    return Q.dq_market_state(shifted)


@query(
    "dq_confidence_tier",
    """SELECT c_custkey FROM (SELECT c_custkey, c_mktsegment, c_acctbal AS sr_hat, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1e0 END AS psr,
         CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 1e0 END AS dsr FROM customer)
       WHERE (psr IS NULL OR dsr IS NULL) AND c_mktsegment <> 'BUILDING'""",
)
def _(v):
    k = F.col("c_custkey")
    rows = v.table("customer").select(
        "c_custkey", F.col("c_acctbal").alias("sr_hat"), F.when(k % 3 != 0, 1.0).alias("psr"), F.when(k % 4 != 0, 1.0).alias("dsr"),
        F.when(F.col("c_mktsegment") == "BUILDING", Q.UNCORRECTED_TIER).otherwise("multi_run").alias("confidence_tier"),
    )
    return Q.dq_confidence_tier(rows).select("c_custkey")


@query(
    "dq_numeric_series",
    """SELECT asset_id, count(*) AS n_rows, count(*) FILTER (WHERE revenue IS NULL) AS n_not_finite,
         count(*) FILTER (WHERE revenue < 0) AS n_negative, count(*) < 150 AS window_too_long
       FROM (SELECT asset_id, revenue - 50000e0 AS revenue FROM filings) GROUP BY 1
       HAVING count(*) FILTER (WHERE revenue IS NULL) > 0 OR count(*) FILTER (WHERE revenue < 0) > 0 OR count(*) < 150""",
)
def _(v):
    series = v.filings.select("asset_id", (F.col("revenue") - 50000.0).alias("revenue"))
    return Q.dq_numeric_series(series, keys=["asset_id"], value="revenue", window=150, allow_negative=False)
