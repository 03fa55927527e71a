"""Registered queries: point-in-time reads, identity, facts, actions, membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog.present import wrap
from tempora.catalog.view_sql import with_views
from tempora.operators import actions as A
from tempora.operators import facts as FA
from tempora.operators import identity as I
from tempora.operators import membership as MB
from tempora.operators import pit as P

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None, columns: str = ""):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = wrap(with_views(sql), columns) if columns else with_views(sql)
        return fn

    return add


@query(
    "pit_slice",
    """SELECT b.asset_id, r.dt AS asof_dt, b.dt, b.closeunadj FROM requests r JOIN bars b ON b.asset_id = r.asset_id
       AND b.dt < r.dt AND b.dt >= r.dt - 30""",
    "asset_id asof_dt:d dt:d closeunadj:f",
)
def _(v):
    asofs = v.requests.withColumnRenamed("dt", "asof_dt")
    out = P.pit_slice(v.bars, asofs, by=["asset_id"], available="dt", asof="asof_dt", lookback=30)
    return out.select("asset_id", "asof_dt", "dt", "closeunadj")


@query(
    "pit_history",
    """SELECT r.asset_id, r.dt AS asof_dt, count(b.dt) AS n_visible, min(b.dt) AS first_visible, max(b.dt) AS last_visible, CAST(sum(b.volume) AS BIGINT) AS sum_volume
       FROM requests r LEFT JOIN bars b ON b.asset_id = r.asset_id AND b.dt < r.dt GROUP BY 1, 2""",
    "asset_id asof_dt:d n_visible first_visible:d last_visible:d sum_volume",
)
def _(v):
    asofs = v.requests.withColumnRenamed("dt", "asof_dt")
    return P.visible_totals(v.bars, asofs, by=["asset_id"], sums=["volume"], available="dt", asof="asof_dt")


@query(
    "pit_visible_at",
    "SELECT asset_id, dt, closeunadj FROM bars WHERE dt < DATE '1997-06-30'",
    "asset_id dt:d closeunadj:f",
)
def _(v):
    return P.visible_at(v.bars, "1997-06-30", available="dt").select("asset_id", "dt", "closeunadj")


@query(
    "lookahead_violations",
    """SELECT asset_id, datekey, asof_dt, 'lookahead leak in filings: available=' || CAST(datekey AS VARCHAR) || ' > asof=' || CAST(asof_dt AS VARCHAR)
        || ' period_end=' || CAST(calendardate AS VARCHAR) AS message
       FROM (SELECT *, calendardate + 30 AS asof_dt FROM filings) WHERE datekey > asof_dt""",
    "asset_id datekey:d asof_dt:d message",
)
def _(v):
    df = v.filings.withColumn("asof_dt", F.date_add("calendardate", 30))
    out = P.lookahead_violations(df, available="datekey", asof="asof_dt", context="filings", period_end="calendardate")
    return out.select("asset_id", "datekey", "asof_dt", "message")


_ASOF = """SELECT r.asset_id, r.dt, {cols} FROM requests r LEFT JOIN LATERAL (
   SELECT * FROM facts f WHERE f.asset_id = r.asset_id AND f.dimension = '{dim}' AND f.datekey <= r.dt
   ORDER BY f.datekey DESC, f.calendardate DESC LIMIT 1) h ON true"""


@query("asof_fundamental", _ASOF.format(cols="revenue", dim="ARQ"), "asset_id dt:d revenue:f")
def _(v):
    return FA.asof_facts(v.requests, v.facts, ["revenue"], dimension="arq")


@query("asof_fundamental_yearly", _ASOF.format(cols="revenue, sharesbas", dim="ARY"), "asset_id dt:d revenue:f sharesbas:f")
def _(v):
    return FA.asof_facts(v.requests, v.facts, ["revenue", "sharesbas"], dimension="ARY")


@query(
    "shares_outstanding",
    f"SELECT *, CASE WHEN sharesbas IS NOT NULL THEN 'sf1' END AS source, false AS estimated FROM ({_ASOF.format(cols='sharesbas', dim='ARQ')})",
    "asset_id dt:d sharesbas:f source estimated",
)
def _(v):
    return FA.shares_outstanding(v.requests, v.facts)


@query(
    "market_cap",
    f"""SELECT a.asset_id, a.dt, coalesce(marketcap, sharesbas * closeunadj) AS market_cap,
      CASE WHEN marketcap IS NOT NULL THEN 'sf1' WHEN sharesbas * closeunadj IS NOT NULL THEN 'sep_estimated' END AS source,
      marketcap IS NULL AND sharesbas * closeunadj IS NOT NULL AS estimated,
      CASE WHEN coalesce(marketcap, sharesbas * closeunadj) IS NULL THEN 'none' ELSE 'ok' END AS status
    FROM ({_ASOF.format(cols='marketcap, sharesbas', dim='ARQ')}) a LEFT JOIN bars b ON a.asset_id = b.asset_id AND a.dt = b.dt""",
    "asset_id dt:d market_cap:f source estimated status",
)
def _(v):
    return FA.market_cap(v.requests, v.facts, v.bars)


_RESOLVE = """SELECT {key}, dt, CASE WHEN n = 1 THEN x END AS {out},
   CASE WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM (
   SELECT r.{key}, r.dt, count(s.permaticker) AS n, min({pick}) AS x FROM {req} r LEFT JOIN securities s
   ON s.{skey} = r.{key} AND s.firstpricedate IS NOT NULL AND r.dt >= s.firstpricedate
      AND (s.lastpricedate IS NULL OR r.dt <= s.lastpricedate) GROUP BY 1, 2)"""
_BY_TICKER = _RESOLVE.format(key="ticker", skey="ticker", out="asset_id", pick="s.permaticker", req="ticker_requests")
_BY_ASSET = _RESOLVE.format(key="asset_id", skey="permaticker", out="ticker", pick="s.ticker", req="requests")


@query("resolve_asset", _BY_TICKER, "ticker dt:d asset_id status")
def _(v):
    return I.resolve_asset(v.ticker_requests, v.securities)


@query("resolve_ticker", _BY_ASSET, "asset_id dt:d ticker status")
def _(v):
    return I.resolve_ticker(v.requests, v.securities)


@query(
    "resolve_unique",
    """SELECT t.ticker, CASE WHEN n = 1 THEN a END AS asset_id, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status
    FROM (SELECT DISTINCT ticker FROM ticker_requests) t LEFT JOIN (
      SELECT ticker, count(DISTINCT permaticker) AS n, min(permaticker) AS a FROM securities WHERE firstpricedate IS NOT NULL GROUP BY 1) u
    ON t.ticker = u.ticker""",
)
def _(v):
    return I.resolve_unique(v.ticker_requests.select("ticker").distinct(), v.securities)


@query(
    "known_assets",
    """SELECT r.asset_id, r.dt FROM requests r WHERE EXISTS (
       SELECT 1 FROM securities s WHERE s.permaticker = r.asset_id AND s.firstpricedate IS NOT NULL)""",
    "asset_id dt:d",
)
def _(v):
    return I.known_assets(v.requests, v.securities)


@query(
    "lookup_price",
    f"""SELECT a.asset_id, a.dt, CASE WHEN a.status = 'ok' AND n = 1 THEN px END AS close,
      CASE WHEN a.status <> 'ok' THEN 'ticker_' || a.status WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS status
    FROM ({_BY_ASSET}) a LEFT JOIN (SELECT ticker, dt, count(*) AS n, max(close) AS px FROM bars GROUP BY 1, 2) b
    ON a.ticker = b.ticker AND a.dt = b.dt""",
    "asset_id dt:d close:f status",
)
def _(v):
    return FA.lookup_price(v.requests, v.bars, v.securities, "close")


_KIND = """CASE action WHEN 'dividend' THEN 'cash_dividend' WHEN 'spinoff' THEN 'spinoff_cash_equivalent' WHEN 'split' THEN 'split' END"""


@query(
    "classify_actions",
    f"SELECT asset_id, date, action, {_KIND} AS action_type, value FROM actions WHERE action IN ('dividend', 'spinoff', 'split')",
    "asset_id date:d action action_type value:f",
)
def _(v):
    return A.classify_actions(v.actions)[0].select("asset_id", "date", "action", "action_type", "value")


@query(
    "unknown_actions",
    "SELECT asset_id, date, action FROM actions WHERE action NOT IN ('dividend', 'spinoff', 'split', 'listed')",
    "asset_id date:d action",
)
def _(v):
    return A.classify_actions(v.actions)[1].select("asset_id", "date", "action")


@query(
    "corporate_actions",
    """SELECT r.asset_id, r."start", r."end", a.date AS ex_date, a.value AS ratio FROM ranges r JOIN actions a
       ON a.asset_id = r.asset_id AND a.action = 'split' AND a.date BETWEEN r."start" AND r."end" """,
    "asset_id start:d end:d ex_date:d ratio:f".replace("start", '"start"').replace(" end", ' "end"'),
)
def _(v):
    return A.corporate_actions(v.ranges, v.actions)


_DELIST = """SELECT s.permaticker AS asset_id, s.ticker, s.lastpricedate AS dt, CASE WHEN n = 1 THEN px END AS amount,
   CASE WHEN n IS NULL THEN 'missing_bar' WHEN n > 1 THEN 'duplicate_bar' ELSE 'ok' END AS status
   FROM securities s LEFT JOIN (SELECT ticker, dt, count(*) AS n, max(closeunadj) AS px FROM bars GROUP BY 1, 2) b
   ON s.ticker = b.ticker AND s.lastpricedate = b.dt WHERE s.isdelisted = 'Y' AND s.lastpricedate IS NOT NULL"""


@query("delisting_proceeds", _DELIST, "asset_id ticker dt:d amount:f status")
def _(v):
    return A.delisting_proceeds(v.securities, v.bars)


@query(
    "cash_flows",
    f"""SELECT f.asset_id, f.dt, flow_type, amount, flow_order, r."start", r."end" FROM (
      SELECT asset_id, date AS dt, {_KIND} AS flow_type, value AS amount,
             CASE action WHEN 'dividend' THEN 0 ELSE 1 END AS flow_order FROM actions WHERE action IN ('dividend', 'spinoff')
      UNION ALL SELECT asset_id, dt, 'delisting_cash_proceeds', amount, 2 FROM ({_DELIST}) WHERE status = 'ok') f
    JOIN ranges r ON r.asset_id = f.asset_id AND f.dt BETWEEN r."start" AND r."end" """,
    'asset_id dt:d flow_type amount:f flow_order:i "start":d "end":d',
)
def _(v):
    return A.cash_flows(v.ranges, v.actions, v.securities, v.bars)


@query(
    "membership_snapshots",
    """SELECT s.snapshot_date, s.ticker, CASE WHEN n = 1 THEN a END AS asset_id,
        CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status
    FROM (SELECT DISTINCT date AS snapshot_date, ticker FROM membership_log WHERE action IN ('historical', 'current')) s
    LEFT JOIN (SELECT ticker, count(DISTINCT permaticker) AS n, min(permaticker) AS a FROM securities
               WHERE firstpricedate IS NOT NULL GROUP BY 1) u ON s.ticker = u.ticker""",
    "snapshot_date:d ticker asset_id status",
)
def _(v):
    return MB.membership_snapshots(v.membership_log, v.securities)


_MEMBERS = """SELECT d.dt, m.snapshot_date, m.asset_id FROM (SELECT DISTINCT dt FROM month_ends) d JOIN membership m
   ON m.snapshot_date = (SELECT max(snapshot_date) FROM membership x WHERE x.snapshot_date <= d.dt)"""


@query("members_at", _MEMBERS, "dt:d snapshot_date:d asset_id")
def _(v):
    return MB.members_at(v.month_ends.select("dt"), v.membership)


@query(
    "is_member",
    """SELECT r.asset_id, r.dt, EXISTS (SELECT 1 FROM membership m WHERE m.asset_id = r.asset_id AND m.snapshot_date =
       (SELECT max(snapshot_date) FROM membership x WHERE x.snapshot_date <= r.dt)) AS is_member FROM requests r""",
    "asset_id dt:d is_member",
)
def _(v):
    return MB.is_member(v.requests, v.membership)


@query(
    "membership_spells",
    """WITH d AS (SELECT snapshot_date, dense_rank() OVER (ORDER BY snapshot_date) AS pos FROM (SELECT DISTINCT snapshot_date FROM membership)),
    g AS (SELECT m.asset_id, m.snapshot_date, d.pos - row_number() OVER (PARTITION BY m.asset_id ORDER BY d.pos) AS run
          FROM membership m JOIN d USING (snapshot_date))
    SELECT asset_id, min(snapshot_date) AS spell_start,
      CASE WHEN max(snapshot_date) = (SELECT max(snapshot_date) FROM membership) THEN NULL ELSE max(snapshot_date) END AS spell_end
    FROM g GROUP BY asset_id, run""",
    "asset_id spell_start:d spell_end:d",
)
def _(v):
    return MB.membership_spells(v.membership)


@query("ever_members", f"SELECT DISTINCT asset_id FROM ({_MEMBERS})")
def _(v):
    return MB.ever_members(v.month_ends.select("dt"), v.membership)


@query(
    "asset_ticker_map",
    """SELECT a.asset_id, s.ticker, CASE WHEN s.ticker IS NULL THEN 'absent' ELSE 'ok' END AS status FROM (
       SELECT DISTINCT asset_id FROM membership UNION SELECT DISTINCT o_custkey % 130 FROM orders) a
       LEFT JOIN securities s ON s.permaticker = a.asset_id""",
)
def _(v):
    extra = v.table("orders").select((F.col("o_custkey") % 130).alias("asset_id"))
    return I.asset_ticker_map(v.membership.select("asset_id").unionByName(extra), v.securities)


@query(
    "untradeable_members",
    f"""SELECT dt, count(*) AS n_members, count(*) FILTER (WHERE listed = 0) AS n_untradeable,
       count(*) FILTER (WHERE listed = 0) / CAST(count(*) AS DOUBLE) AS share FROM (
       SELECT m.dt, m.asset_id, (SELECT count(*) FROM securities s WHERE s.permaticker = m.asset_id AND s.firstpricedate <= m.dt
         AND (s.lastpricedate IS NULL OR s.lastpricedate >= m.dt)) AS listed FROM ({_MEMBERS}) m) GROUP BY 1""",
    "dt:d n_members n_untradeable share:f",
)
def _(v):
    return MB.untradeable_members(v.month_ends.select("dt"), v.membership, v.securities)
