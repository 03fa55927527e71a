"""The same views as SQL text for the comparison engine."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["daily"] = """
SELECT l_suppkey AS asset_id, CAST(l_shipdate AS DATE) AS dt, count(*) AS n,
       CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc,
       CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax,
       max(CAST(round(l_tax * 100) AS BIGINT)) AS max_tax,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume,
       CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * CAST(l_quantity AS BIGINT)) AS BIGINT) AS net,
       bool_or(l_returnflag = 'R') AS has_r
FROM lineitem GROUP BY 1, 2"""

VIEWS["bars"] = """
SELECT asset_id, 'T' || CAST(asset_id // 100 * 90 + asset_id % 100 % 90 AS VARCHAR) AS ticker, dt,
       close * (1e0 + 1e-3 * (n - 1)) AS open, close * 1.01e0 AS high, close * 0.99e0 AS low,
       close, close + 1e0 AS closeunadj, volume
FROM (SELECT *, round(50e0 + 5e0 * disc / n + 2.5e0 * tax / n, 6) AS close FROM daily)"""

VIEWS["calendar"] = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS dt FROM lineitem"

VIEWS["dividends"] = """
SELECT asset_id, 'T' || CAST(asset_id // 100 * 90 + asset_id % 100 % 90 AS VARCHAR) AS ticker, dt AS ex_date,
       round(0.01e0 + 0.005e0 * max_tax, 6) AS amount_per_share
FROM daily WHERE has_r AND n >= 2"""

VIEWS["actions"] = """
SELECT asset_id, ticker, ex_date AS date, 'dividend' AS action, amount_per_share AS value FROM dividends
UNION ALL SELECT asset_id, 'T' || CAST(asset_id // 100 * 90 + asset_id % 100 % 90 AS VARCHAR), dt, 'split',
       CASE WHEN asset_id % 2 = 1 THEN 5e-1 ELSE 2e0 END FROM daily
  WHERE (asset_id * 31 + (dt - DATE '1970-01-01')) % 173 = 0
UNION ALL SELECT asset_id, 'T' || CAST(asset_id // 100 * 90 + asset_id % 100 % 90 AS VARCHAR), dt, 'spinoff', 0.25e0 FROM daily
  WHERE (asset_id * 17 + (dt - DATE '1970-01-01')) % 211 = 0
UNION ALL SELECT asset_id, 'T' || CAST(asset_id // 100 * 90 + asset_id % 100 % 90 AS VARCHAR), dt, 'listed', 0e0 FROM daily
  WHERE (dt - DATE '1970-01-01') % 307 = 0
UNION ALL SELECT asset_id, 'T' || CAST(asset_id // 100 * 90 + asset_id % 100 % 90 AS VARCHAR), dt, 'rightsissue', 1.5e0 FROM daily
  WHERE asset_id % 10 = 0 AND (dt - DATE '1970-01-01') % 97 = 0"""

VIEWS["securities"] = """
SELECT asset_id AS permaticker, 'T' || CAST(asset_id // 100 * 90 + asset_id % 100 % 90 AS VARCHAR) AS ticker,
       CASE WHEN asset_id % 5 = 0 THEN 'Y' ELSE 'N' END AS isdelisted,
       CASE WHEN asset_id % 37 = 36 THEN NULL
            WHEN asset_id % 100 >= 90 AND asset_id % 2 = 1 THEN DATE '1999-01-01' ELSE lo END AS firstpricedate,
       CASE WHEN asset_id % 100 < 10 AND asset_id % 2 = 1 THEN DATE '1998-12-31'
            WHEN asset_id % 5 = 0 THEN hi ELSE NULL END AS lastpricedate
FROM (SELECT asset_id, min(dt) AS lo, max(dt) AS hi FROM daily GROUP BY 1)"""

VIEWS["filings"] = """
SELECT o_custkey % n AS asset_id, 'T' || CAST(o_custkey % n // 100 * 90 + o_custkey % n % 100 % 90 AS VARCHAR) AS ticker,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ARQ' WHEN '2' THEN 'ARQ' WHEN '3' THEN 'ART'
            WHEN '4' THEN 'ARY' ELSE 'MRQ' END AS dimension,
       last_day(CAST(o_orderdate AS DATE)) AS calendardate,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 45 END AS datekey,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS revenue,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice * 10e0 END AS marketcap,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey + 1 AS DOUBLE) END AS sharesbas
FROM orders, (SELECT max(l_suppkey) + 1 AS n FROM lineitem)"""

VIEWS["facts"] = """
SELECT asset_id, dimension, datekey, calendardate, max(revenue) AS revenue, max(marketcap) AS marketcap,
       max(sharesbas) AS sharesbas FROM filings GROUP BY 1, 2, 3, 4"""

VIEWS["rosters"] = """
SELECT r.q, e.snapshot_date, r.asset_id FROM (
  SELECT q, asset_id, row_number() OVER (PARTITION BY q ORDER BY v DESC, asset_id) AS rk, count(*) OVER (PARTITION BY q) AS n FROM (
    SELECT year(dt) * 4 + quarter(dt) AS q, asset_id, sum(volume) AS v FROM daily GROUP BY 1, 2)) r
JOIN (SELECT year(dt) * 4 + quarter(dt) AS q, max(dt) AS snapshot_date FROM calendar GROUP BY 1) e ON r.q = e.q
WHERE 2 * rk <= n + 1"""

VIEWS["membership"] = "SELECT snapshot_date, asset_id FROM rosters"

VIEWS["membership_log"] = """
SELECT asset_id, 'T' || CAST(asset_id // 100 * 90 + asset_id % 100 % 90 AS VARCHAR) AS ticker, date, action FROM (
  SELECT asset_id, snapshot_date AS date,
         CASE WHEN q = (SELECT max(q) FROM rosters) THEN 'current' ELSE 'historical' END AS action FROM rosters
  UNION ALL
  SELECT asset_id, snapshot_date - 20 AS date,
         CASE WHEN (asset_id + q) % 13 <> 0 THEN raw WHEN raw = 'added' THEN 'removed' ELSE 'added' END AS action
  FROM (
    SELECT a.asset_id, a.q, 'added' AS raw FROM rosters a
      WHERE NOT EXISTS (SELECT 1 FROM rosters p WHERE p.q = a.q - 1 AND p.asset_id = a.asset_id)
    UNION ALL
    SELECT a.asset_id, a.q + 1 AS q, 'removed' AS raw FROM rosters a
      WHERE NOT EXISTS (SELECT 1 FROM rosters p WHERE p.q = a.q + 1 AND p.asset_id = a.asset_id)
  ) ev JOIN (SELECT DISTINCT q, snapshot_date FROM rosters) d USING (q)
  JOIN (SELECT unnest([1, 2]) AS copy) c ON c.copy = 1 OR ev.asset_id % 11 = 0
  WHERE q > (SELECT min(q) FROM rosters))"""

VIEWS["month_ends"] = "SELECT date_trunc('month', dt) AS m, max(dt) AS dt FROM calendar GROUP BY 1"

VIEWS["requests"] = """
SELECT a.asset_id, e.dt FROM (SELECT DISTINCT asset_id, date_trunc('month', dt) AS m FROM daily) a
JOIN month_ends e ON a.m = e.m"""

VIEWS["ticker_requests"] = """
SELECT DISTINCT CASE WHEN asset_id % 19 = 18 THEN 'U' || CAST(asset_id AS VARCHAR) ELSE 'T' || CAST(asset_id // 100 * 90 + asset_id % 100 % 90 AS VARCHAR) END AS ticker, dt
FROM requests"""

VIEWS["ranges"] = 'SELECT asset_id, dt - 60 AS "start", dt AS "end" FROM requests WHERE month(dt) % 3 = 0'

VIEWS["trade_orders"] = """
SELECT CAST(dt AS VARCHAR) || '_' || CAST(asset_id AS VARCHAR) AS order_id, asset_id, dt, CAST(net AS DOUBLE) AS shares,
       CASE asset_id % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'CLOSE' ELSE 'ARRIVAL' END AS fill_model FROM daily"""

VIEWS["theta"] = """
SELECT DISTINCT asset_id, CAST((asset_id % 7 + 1) * 100000 AS DOUBLE) AS theta FROM daily"""

VIEWS["returns_daily"] = """
SELECT asset_id, dt, volume, closeunadj, closeunadj / lag(closeunadj) OVER (PARTITION BY asset_id ORDER BY dt) - 1 AS ret
FROM bars"""

VIEWS["market_state"] = """
SELECT s.asset_id, dt, sigma_d, v_d, theta FROM (
  SELECT asset_id, dt,
    CASE WHEN count(ret) OVER w >= 20 THEN stddev_pop(ret) OVER w END AS sigma_d,
    CASE WHEN count(volume) OVER w >= 20 THEN avg(volume) OVER w END AS v_d
  FROM returns_daily WINDOW w AS (PARTITION BY asset_id ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) s
JOIN theta t ON s.asset_id = t.asset_id WHERE sigma_d IS NOT NULL"""

VIEWS["hourly_curves"] = """
SELECT curve_id, dt, round(100e0 * product(m) OVER (PARTITION BY curve_id ORDER BY dt
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS nav FROM (
  SELECT curve_id, dt, 1e0 + round(s / 100e0 / n - 50e0, 6) / 5000e0 AS m FROM (
    SELECT event_type AS curve_id, date_trunc('hour', ts) AS dt, count(*) AS n,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS s FROM events GROUP BY 1, 2))"""

VIEWS["multipliers"] = """
SELECT asset_id, dt, closeunadj, CASE WHEN prev IS NULL THEN 1e0 ELSE (closeunadj + coalesce(amount, 0e0)) / prev END AS m
FROM (SELECT b.asset_id, b.dt, closeunadj, amount, lag(closeunadj) OVER (PARTITION BY b.asset_id ORDER BY b.dt) AS prev
      FROM bars b LEFT JOIN (SELECT asset_id, ex_date, sum(amount_per_share) AS amount FROM dividends GROUP BY 1, 2) d
      ON b.asset_id = d.asset_id AND b.dt = d.ex_date)"""

VIEWS["total_return"] = """
SELECT asset_id, dt, product(m) OVER (PARTITION BY asset_id ORDER BY dt
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tr, m - 1 AS daily_return FROM multipliers"""

VIEWS["asset_curves"] = "SELECT asset_id AS curve_id, dt, round(100e0 * tr, 8) AS nav FROM total_return"

VIEWS["curve_returns"] = """
SELECT curve_id, dt, r FROM (
  SELECT curve_id, dt, nav / lag(nav) OVER (PARTITION BY curve_id ORDER BY dt) - 1 AS r FROM asset_curves) WHERE r IS NOT NULL"""

VIEWS["curve_moments"] = """
SELECT curve_id, n, mu, sd, m3 / power(m2, 1.5e0) AS gamma_3, m4 / (m2 * m2) AS gamma_4, mu / sd AS sr_hat FROM (
  SELECT r.curve_id, max(a.n) AS n, max(a.mu) AS mu, max(a.sd) AS sd, avg((r - mu) * (r - mu)) AS m2,
         avg((r - mu) * (r - mu) * (r - mu)) AS m3, avg((r - mu) * (r - mu) * (r - mu) * (r - mu)) AS m4
  FROM curve_returns r JOIN (SELECT curve_id, count(*) AS n, avg(r) AS mu, stddev_samp(r) AS sd
                             FROM curve_returns GROUP BY 1) a ON r.curve_id = a.curve_id GROUP BY 1)"""

VIEWS["observations"] = """
SELECT dt, dt + 3 + CAST((dt - DATE '1970-01-01') % 9 AS INTEGER) AS label_end
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders)"""

VIEWS["trials"] = """
SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS dataset_fingerprint, c_mktsegment AS strategy_family,
       c_acctbal / 10000e0 AS sr_hat, CAST(c_custkey % 90 + 1 AS INTEGER) AS t_observations,
       (c_custkey % 5 - 2) / 10e0 AS gamma_3, 3e0 + c_custkey % 4 AS gamma_4, c_name, c_nationkey FROM customer"""


def with_views(body: str) -> str:
    """Prefix `body` with the WITH list of every view it mentions, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name, sql in VIEWS.items():
            if name not in order and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                visit(sql)
                if name not in order:
                    order.append(name)

    visit(body)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order)
    if not ctes:
        return body
    if re.match(r"\s*WITH RECURSIVE\s", body):
        return f"WITH RECURSIVE {ctes},\n{re.sub(r'^\s*WITH RECURSIVE', '', body, count=1)}"
    if re.match(r"\s*WITH\s", body):
        return f"WITH {ctes},\n{re.sub(r'^\s*WITH', '', body, count=1)}"
    return f"WITH {ctes}\n{body}"
