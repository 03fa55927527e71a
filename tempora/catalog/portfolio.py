"""Registered queries: weights, trades, costs, valuation, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog.present import wrap
from tempora.catalog.view_sql import with_views
from tempora.functions import costs as K
from tempora.operators import costs as C
from tempora.operators import portfolio as P
from tempora.operators import scenarios as S

QUERIES = {}
ORACLE = {}
CAPITAL = 1_000_000.0


def query(name: str, sql: str | None = None, columns: str = "", digits: int = 6):
    def add(fn):
        fn.digits = digits
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = wrap(with_views(sql), columns, digits) if columns else with_views(sql)
        return fn

    return add


def scores_of(v):
    day = F.datediff("dt", F.lit("1970-01-01").cast("date"))
    return v.requests.select("dt", "asset_id", ((F.col("asset_id") * 37 + day * 11) % 23 / 10.0).alias("score"))


SCORES = "(SELECT dt, asset_id, (asset_id * 37 + (dt - DATE '1970-01-01') * 11) % 23 / 10e0 AS score FROM requests)"
TOP = f"""SELECT dt, asset_id, score, 1e0 / k AS weight FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY score DESC, asset_id) AS rn,
   CAST(ceil(count(*) OVER (PARTITION BY dt) / 5e0) AS BIGINT) AS k FROM {SCORES}) WHERE rn <= k"""


@query("equal_weight", "SELECT asset_id, dt, 1e0 / count(*) OVER (PARTITION BY dt) AS weight FROM requests", "asset_id dt:d weight:f")
def _(v):
    return P.equal_weight(v.requests)


@query("top_quantile", TOP, "dt:d asset_id score:f weight:f")
def _(v):
    return P.top_quantile(scores_of(v))


RENORM = f"""SELECT t.dt, t.asset_id, closeunadj AS price, weight / sum(weight) OVER (PARTITION BY t.dt) AS weight FROM ({TOP}) t
   JOIN bars b ON b.asset_id = t.asset_id AND b.dt = t.dt"""


@query("renormalize_weights", RENORM, "dt:d asset_id price:f weight:f")
def _(v):
    return P.renormalize(P.top_quantile(scores_of(v)), v.bars)


@query(
    "target_dollars",
    f"SELECT dt, asset_id, weight, (1e6 + 100 * (dt - DATE '1995-01-01')) * weight AS target_dollars FROM ({RENORM})",
    "dt:d asset_id weight:f target_dollars:f",
)
def _(v):
    nav = v.month_ends.select(
        "dt", (F.lit(CAPITAL) + 100 * F.datediff("dt", F.lit("1995-01-01").cast("date"))).alias("nav")
    )
    out = P.target_dollars(P.renormalize(P.top_quantile(scores_of(v)), v.bars), nav)
    return out.select("dt", "asset_id", "weight", "target_dollars")


def share_targets(v):
    w = P.renormalize(P.top_quantile(scores_of(v)), v.bars)
    return w.select(F.lit("top").alias("curve_id"), "dt", "asset_id", (F.lit(CAPITAL) * F.col("weight") / F.col("price")).alias("shares"))


SHARES = f"(SELECT 'top' AS curve_id, dt, asset_id, 1e6 * weight / price AS shares FROM ({RENORM}))"


@query(
    "rebalance_trades",
    f"""WITH d AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS nx FROM (SELECT DISTINCT dt FROM {SHARES})),
    cur AS (SELECT * FROM {SHARES}), prv AS (SELECT d.nx AS dt, c.asset_id, c.shares FROM cur c JOIN d USING (dt) WHERE d.nx IS NOT NULL)
    SELECT 'top' AS curve_id, coalesce(c.dt, p.dt) AS dt, coalesce(c.asset_id, p.asset_id) AS asset_id, coalesce(c.shares, 0) - coalesce(p.shares, 0) AS quantity
    FROM cur c FULL OUTER JOIN prv p ON c.dt = p.dt AND c.asset_id = p.asset_id WHERE coalesce(c.shares, 0) <> coalesce(p.shares, 0)""",
    "curve_id dt:d asset_id quantity:f",
)
def _(v):
    return P.rebalance_trades(share_targets(v))


# Weights are quotients of sums of doubles; equal holdings may differ in their last bits.
@query(
    "rebalance_trades_keep_dropped",
    f"""SELECT curve_id, dt, asset_id, shares - held AS quantity
       FROM (SELECT *, coalesce(lag(shares) OVER (PARTITION BY asset_id ORDER BY dt), 0) AS held FROM {SHARES})
       WHERE abs(shares - held) > 1e-9 * greatest(abs(shares), abs(held))""",
    "curve_id dt:d asset_id quantity:f",
)
def _(v):
    return P.rebalance_trades(share_targets(v), liquidate_dropped=False, rounding=1e-9)


PRIOR = "(SELECT *, lag(closeunadj) OVER (PARTITION BY asset_id ORDER BY dt) AS prior_close FROM bars)"
ARRIVE = f"""SELECT o.order_id, o.asset_id, o.dt, o.shares, o.fill_model, CASE fill_model WHEN 'OPEN' THEN open WHEN 'CLOSE' THEN closeunadj ELSE prior_close END AS arrival,
   s.sigma_d, s.v_d, s.theta, CASE WHEN fill_model = 'ARRIVAL' AND prior_close IS NULL THEN 'no_prior_close' WHEN shares <> 0 AND sigma_d IS NULL THEN 'no_market_state' ELSE 'ok' END AS status
   FROM trade_orders o JOIN {PRIOR} b ON b.asset_id = o.asset_id AND b.dt = o.dt LEFT JOIN market_state s ON s.asset_id = o.asset_id AND s.dt = o.dt"""
IMPACT = f"""SELECT *, CASE WHEN shares = 0 THEN 0 ELSE 0.5e0 * 0.314e0 * sigma_d * (abs(shares) / v_d) * power(theta / v_d, 0.25e0) * 1e4 END AS perm,
   CASE WHEN shares = 0 THEN 0 ELSE 0.142e0 * sigma_d * power(abs(shares) / v_d, 0.6e0) * 1e4 END AS temp FROM ({ARRIVE})"""
FILLS = f"""SELECT order_id, asset_id, dt, shares, fill_model, arrival, arrival * (1 + sign(shares) * temp / 1e4) AS fill_price, 0e0 AS slippage_bps,
   temp AS temporary_impact_bps, perm AS permanent_impact_bps, sign(shares) * perm / 1e4 * arrival * (1 + sign(shares) * temp / 1e4) AS permanent_impact_per_share,
   abs(shares) * 0.005e0 + abs(shares * arrival * (1 + sign(shares) * temp / 1e4)) * 0.3e0 / 1e4 AS commission, status FROM ({IMPACT}) WHERE status = 'ok'"""
COMM = {"commission_per_share": 0.005, "commission_bps": 0.3}


@query(
    "arrival_price",
    f"SELECT order_id, fill_model, CASE WHEN status <> 'no_prior_close' THEN arrival END AS arrival, CASE WHEN status = 'no_prior_close' THEN status ELSE 'ok' END AS status FROM ({ARRIVE})",
    "order_id fill_model arrival:f status",
)
def _(v):
    px = C.with_prior_close(v.bars).select("asset_id", "dt", "open", "closeunadj", "prior_close")
    m = F.col("fill_model")
    return v.orders.join(px, ["asset_id", "dt"]).select(
        "order_id", "fill_model", K.arrival_price(m, F.col("open"), F.col("closeunadj"), F.col("prior_close")).alias("arrival"),
        K.fill_status(m, F.col("prior_close")).alias("status"),
    )


def stated_orders(v):
    return v.orders.join(v.market_state, ["asset_id", "dt"])


@query(
    "impact_bps",
    f"""SELECT order_id, perm AS permanent_bps, temp AS temporary_bps, CASE WHEN shares = 0 THEN 0 ELSE 0.142e0 * sigma_d * power(abs(shares) / v_d, 0.5e0) * 1e4 END AS square_root_bps
    FROM ({IMPACT}) WHERE sigma_d IS NOT NULL""",
    "order_id permanent_bps:f temporary_bps:f square_root_bps:f",
)
def _(v):
    q = [F.col(c) for c in ("shares", "sigma_d", "v_d", "theta")]
    perm, temp = K.impact_bps(*q)
    _, root = K.impact_bps(*q, beta=K.SQUARE_ROOT_BETA)
    return stated_orders(v).select("order_id", perm.alias("permanent_bps"), temp.alias("temporary_bps"), root.alias("square_root_bps"))


@query("zero_cost", "SELECT order_id, 0e0 AS permanent_bps, 0e0 AS temporary_bps FROM trade_orders", "order_id permanent_bps:f temporary_bps:f")
def _(v):
    perm, temp = K.zero_cost(unsuitable_for_deployment=True)
    return v.orders.select("order_id", perm.alias("permanent_bps"), temp.alias("temporary_bps"))


@query(
    "commission",
    """SELECT order_id, abs(shares) * 0.005e0 AS per_share, abs(shares * closeunadj) * 0.3e0 / 1e4 AS by_notional,
        CAST(CAST(CAST(abs(shares) AS DECIMAL(19,9)) * 0.005 AS DECIMAL(38,18)) AS VARCHAR) AS exact
       FROM trade_orders o JOIN bars b ON b.asset_id = o.asset_id AND b.dt = o.dt""",
    "order_id per_share:f by_notional:f exact", 12,
)
def _(v):
    return v.orders.join(v.bars.select("asset_id", "dt", "closeunadj"), ["asset_id", "dt"]).select(
        "order_id", K.per_share_commission(F.col("shares"), 0.005).alias("per_share"),
        K.notional_commission(F.col("shares") * F.col("closeunadj"), 0.3).alias("by_notional"),
        K.exact_commission(F.col("shares"), "0.005").cast("string").alias("exact"),
    )


FILL_COLS = """order_id asset_id dt:d shares:f fill_model arrival:f fill_price:f slippage_bps:f temporary_impact_bps:f permanent_impact_bps:f
   permanent_impact_per_share:f commission:f status"""


@query(
    "price_fills",
    f"""SELECT * FROM ({FILLS}) UNION ALL SELECT order_id, asset_id, dt, shares, fill_model, NULL, NULL, NULL, NULL, NULL, NULL, NULL, status
       FROM ({ARRIVE}) WHERE status <> 'ok'""",
    FILL_COLS,
)
def _(v):
    return C.price_fills(v.orders, v.bars, v.market_state, **COMM)


@query(
    "dq_single_fill",
    """SELECT asset_id, dt, count(*) AS n_orders FROM (SELECT l_suppkey AS asset_id, CAST(l_shipdate AS DATE) AS dt FROM lineitem) GROUP BY 1, 2 HAVING count(*) > 1""",
    "asset_id dt:d n_orders",
)
def _(v):
    raw = v.table("lineitem").select(F.col("l_suppkey").alias("asset_id"), F.to_date("l_shipdate").alias("dt"), F.col("l_quantity").alias("shares"))
    return C.dq_single_fill(raw)


CUM = f"""SELECT asset_id, dt, coalesce(sum(d) OVER (PARTITION BY asset_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS impact_before,
   sum(d) OVER (PARTITION BY asset_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS impact_after
   FROM (SELECT asset_id, dt, sum(permanent_impact_per_share) AS d FROM ({FILLS}) GROUP BY 1, 2)"""


def good_fills(v):
    return C.price_fills(v.orders, v.bars, v.market_state, **COMM).filter(F.col("status") == "ok")


@query("cumulative_impact", CUM, "asset_id dt:d impact_before:f impact_after:f")
def _(v):
    return C.cumulative_impact(good_fills(v))


@query(
    "impact_adjusted_prices",
    f"""SELECT b.asset_id, b.dt, closeunadj + coalesce(impact_after, 0) AS adjusted_price FROM bars b
       ASOF LEFT JOIN ({CUM}) c ON b.asset_id = c.asset_id AND b.dt >= c.dt""",
    "asset_id dt:d adjusted_price:f",
)
def _(v):
    return C.adjust_prices(v.bars, C.cumulative_impact(good_fills(v))).select("asset_id", "dt", "adjusted_price")


@query(
    "impact_feedback",
    f"""WITH RECURSIVE f AS MATERIALIZED (SELECT asset_id, dt, arrival, shares, temporary_impact_bps AS t, permanent_impact_bps AS p,
        row_number() OVER (PARTITION BY asset_id ORDER BY dt) AS rn FROM ({FILLS})),
    walk AS (SELECT asset_id, dt, rn, 0e0 AS impact_before, arrival * (1 + sign(shares) * t / 1e4) AS fill_price,
        sign(shares) * p / 1e4 * arrival * (1 + sign(shares) * t / 1e4) AS impact_after FROM f WHERE rn = 1
      UNION ALL SELECT f.asset_id, f.dt, f.rn, w.impact_after, (f.arrival + w.impact_after) * (1 + sign(f.shares) * f.t / 1e4),
        w.impact_after + sign(f.shares) * f.p / 1e4 * (f.arrival + w.impact_after) * (1 + sign(f.shares) * f.t / 1e4)
      FROM walk w JOIN f ON f.asset_id = w.asset_id AND f.rn = w.rn + 1)
    SELECT asset_id, dt, impact_before, impact_after, fill_price FROM walk""",
    "asset_id dt:d impact_before:f impact_after:f fill_price:f",
)
def _(v):
    return C.impact_feedback(good_fills(v)).select("asset_id", "dt", "impact_before", "impact_after", "fill_price")


@query(
    "implementation_shortfall",
    f"""SELECT asset_id, sum(slippage_bps) AS slippage_bps, sum(temporary_impact_bps) AS temporary_impact_bps, sum(permanent_impact_bps) AS permanent_impact_bps,
       sum(commission) AS commission, sum(temporary_impact_bps + permanent_impact_bps) AS total_bps FROM ({FILLS}) GROUP BY 1""",
    "asset_id slippage_bps:f temporary_impact_bps:f permanent_impact_bps:f commission:f total_bps:f",
)
def _(v):
    return C.implementation_shortfall(C.price_fills(v.orders, v.bars, v.market_state, **COMM))


@query(
    "estimate_vs_fill",
    f"""SELECT asset_id, dt, estimate_bps, fill_bps, drift AS mid_drift_bps, 0.5e0 + 0.1e0 * abs(drift) AS tolerance_bps,
        abs(estimate_bps - fill_bps) <= 0.5e0 + 0.1e0 * abs(drift) AS within FROM (
      SELECT f.asset_id, f.dt, 1.1e0 * (temporary_impact_bps + permanent_impact_bps) AS estimate_bps, temporary_impact_bps + permanent_impact_bps AS fill_bps,
        ((b.open + b.closeunadj) / 2 - coalesce(prior_close, b.open)) / coalesce(prior_close, b.open) * 1e4 AS drift
      FROM ({FILLS}) f JOIN {PRIOR} b ON b.asset_id = f.asset_id AND b.dt = f.dt)""",
    "asset_id dt:d estimate_bps:f fill_bps:f mid_drift_bps:f tolerance_bps:f within", 5,
)
def _(v):
    fills = C.price_fills(v.orders, v.bars, v.market_state, **COMM).withColumn(
        "estimate_bps", 1.1 * (F.col("temporary_impact_bps") + F.col("permanent_impact_bps"))
    )
    return C.estimate_vs_fill(fills, v.bars)


def curve_weights(v):
    """Four curves with different members and rebalance dates."""
    c = F.col("asset_id") % 4
    rows = v.requests.filter((c >= 2) | (F.month("dt") % 3 == 0)).join(v.bars.select("asset_id", "dt"), ["asset_id", "dt"])
    return P.equal_weight(rows.select(c.alias("curve_id"), "dt", "asset_id"), keys=["curve_id", "dt"])


WEIGHTS = """(SELECT curve_id, dt, asset_id, 1e0 / count(*) OVER (PARTITION BY curve_id, dt) AS weight, p0 FROM (
   SELECT r.asset_id % 4 AS curve_id, r.dt, r.asset_id, b.closeunadj AS p0 FROM requests r JOIN bars b ON b.asset_id = r.asset_id AND b.dt = r.dt
   WHERE r.asset_id % 4 >= 2 OR month(r.dt) % 3 = 0))"""
VALUE = f"""w AS MATERIALIZED (SELECT * FROM {WEIGHTS}),
 per AS MATERIALIZED (SELECT curve_id, dt AS s, lead(dt) OVER (PARTITION BY curve_id ORDER BY dt) AS nx, row_number() OVER (PARTITION BY curve_id ORDER BY dt) AS period
         FROM (SELECT DISTINCT curve_id, dt FROM w)),
 st AS MATERIALIZED (SELECT b.asset_id, b.dt, closeunadj AS px, sum(coalesce(d.a, 0)) OVER (PARTITION BY b.asset_id ORDER BY b.dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cd
        FROM bars b LEFT JOIN (SELECT asset_id, ex_date, sum(amount_per_share) AS a FROM dividends GROUP BY 1, 2) d ON d.asset_id = b.asset_id AND d.ex_date = b.dt),
 ln AS MATERIALIZED (SELECT p.curve_id, p.period, p.s, p.nx, c.dt, w.asset_id, w.weight, w.p0 FROM per p JOIN calendar c ON c.dt >= p.s AND (p.nx IS NULL OR c.dt <= p.nx)
        JOIN w ON w.curve_id = p.curve_id AND w.dt = p.s),
 rel AS MATERIALIZED (SELECT l.curve_id, l.period, l.s, l.nx, l.dt, sum(l.weight * (a.px + a.cd - o.cd) / l.p0) AS rel
        FROM ln l ASOF JOIN st a ON a.asset_id = l.asset_id AND l.dt >= a.dt JOIN st o ON o.asset_id = l.asset_id AND o.dt = l.s GROUP BY 1, 2, 3, 4, 5)"""
CASH = "SELECT p.curve_id, c.dt, 1e6 AS nav FROM calendar c JOIN (SELECT curve_id, min(s) AS f FROM per GROUP BY 1) p ON c.dt < p.f"
NAV = f"""WITH {VALUE},
 op AS (SELECT p.curve_id, p.period, 1e6 * coalesce(product(r.rel) OVER (PARTITION BY p.curve_id ORDER BY p.period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e0) AS o
        FROM per p LEFT JOIN rel r ON r.curve_id = p.curve_id AND r.period = p.period AND r.dt = p.nx)
SELECT r.curve_id, r.dt, o * rel AS nav FROM rel r JOIN op ON op.curve_id = r.curve_id AND op.period = r.period WHERE r.nx IS NULL OR r.dt < r.nx
UNION ALL {CASH}"""


@query("portfolio_nav", NAV, "curve_id dt:d nav:f", 4)
def _(v):
    return P.portfolio_nav(curve_weights(v), v.bars, v.dividends, capital=CAPITAL)


# Costs are sized against a few dozen shares of daily volume, hence the small capital.
SMALL = 10_000.0
COST = """(SELECT sum(abs(q) * px * 0.142e0 * {eta} * coalesce(sigma_d, 0) * power(abs(q) / coalesce(v_d, 1), 0.6e0) + abs(q) * 0.005e0) FROM (
   SELECT coalesce(t.u, 0) * {now} - coalesce(t.b, 0) * {before} AS q, t.px, t.sigma_d, t.v_d FROM tr t WHERE t.curve_id = {curve} AND t.period = {period}))"""
UNQUOTED = """(SELECT count(*) FROM tr t WHERE t.curve_id = {curve} AND t.period = {period} AND t.sigma_d IS NULL
   AND coalesce(t.u, 0) * {now} - coalesce(t.b, 0) * {before} <> 0)"""
COSTED_PARTS = f"""{VALUE},
 g AS MATERIALIZED (SELECT p.curve_id, p.period, r.rel AS growth FROM per p LEFT JOIN rel r ON r.curve_id = p.curve_id AND r.period = p.period AND r.dt = p.nx),
 u AS MATERIALIZED (SELECT w.curve_id, p.period, w.asset_id, weight / p0 AS u FROM w JOIN per p ON p.curve_id = w.curve_id AND p.s = w.dt),
 mv AS MATERIALIZED (SELECT coalesce(a.curve_id, b.curve_id) AS curve_id, coalesce(a.period, b.period) AS period, coalesce(a.asset_id, b.asset_id) AS asset_id, a.u, b.u AS b
        FROM u a FULL OUTER JOIN (SELECT curve_id, period + 1 AS period, asset_id, u FROM u) b ON a.curve_id = b.curve_id AND a.period = b.period AND a.asset_id = b.asset_id),
 tr AS MATERIALIZED (SELECT m.*, q.px, s.sigma_d, s.v_d FROM mv m JOIN per p ON p.curve_id = m.curve_id AND p.period = m.period
        ASOF JOIN st q ON q.asset_id = m.asset_id AND p.s >= q.dt LEFT JOIN market_state s ON s.asset_id = m.asset_id AND s.dt = p.s)"""


def costed_sql(select: str, eta: str = "e.eta / 0.142e0", grid: str = "(SELECT unnest([0.142e0]) AS eta)") -> str:
    start = {"now": "1e4", "before": "0", "curve": "p.curve_id", "period": "1"}
    follow = {"now": "x.nav", "before": "x.nav_prev", "curve": "x.curve_id", "period": "x.period"}
    first, nxt = COST.format(eta=eta, **start), COST.format(eta="x.eta / 0.142e0", **follow)
    return f"""WITH RECURSIVE {COSTED_PARTS},
 walk AS (SELECT p.curve_id, e.eta, CAST(1 AS BIGINT) AS period, 1e4 AS nav, CAST(0 AS DOUBLE) AS nav_prev, {first} AS cost, {UNQUOTED.format(**start)} AS n_unquoted FROM per p CROSS JOIN {grid} e WHERE p.period = 1
   UNION ALL SELECT x.curve_id, x.eta, x.period, x.nav, x.nav_prev, {nxt} AS cost, {UNQUOTED.format(**follow)} AS n_unquoted FROM (
     SELECT k.curve_id, k.eta, k.period + 1 AS period, k.nav * g.growth - k.cost AS nav, k.nav AS nav_prev FROM walk k JOIN g ON g.curve_id = k.curve_id AND g.period = k.period
     WHERE g.growth IS NOT NULL) x)
{select}"""


STEP = {"commission_per_share": 0.005}


@query(
    "portfolio_nav_costed",
    costed_sql(f"""SELECT r.curve_id, r.dt, k.nav * rel - k.cost AS nav, n_unquoted, CASE WHEN n_unquoted > 0 THEN 'no_market_state' ELSE 'ok' END AS status FROM rel r JOIN walk k ON k.curve_id = r.curve_id AND k.period = r.period
       WHERE r.nx IS NULL OR r.dt < r.nx UNION ALL {CASH.replace("1e6 AS nav", "1e4 AS nav, 0, 'ok'")}"""),
    "curve_id dt:d nav:f n_unquoted status", 4,
)
def _(v):
    return P.portfolio_nav_costed(curve_weights(v), v.bars, v.dividends, v.market_state, capital=SMALL, **STEP)


ETAS = (0.05, 0.10, 0.142, 0.20, 0.30)
GRID_SQL = "(SELECT unnest([0.05e0, 0.10e0, 0.142e0, 0.20e0, 0.30e0]) AS eta)"
FINALS = costed_sql(
    """SELECT k.curve_id, k.eta, k.nav * rel - k.cost - 1e4 AS final_pnl FROM rel r JOIN walk k ON k.curve_id = r.curve_id AND k.period = r.period
       WHERE r.nx IS NULL AND r.dt = (SELECT max(dt) FROM calendar)""", grid=GRID_SQL,
)


def sweep(v):
    nav = P.portfolio_nav_costed(
        curve_weights(v), v.bars, v.dividends, v.market_state, capital=SMALL, eta=F.col("eta"), grid=("eta", ETAS), **STEP
    )
    return P.curve_summary(nav, keys=["curve_id", "eta"], capital=SMALL)


@query("param_sweep", f"SELECT * FROM ({FINALS})", "curve_id eta:f final_pnl:f", 4)
def _(v):
    return sweep(v).select("curve_id", "eta", "final_pnl")


@query(
    "sensitivity_band",
    f"""SELECT a.curve_id, a.eta, a.final_pnl, (a.final_pnl - c.final_pnl) / 1e4 * 1e4 AS delta_bps_vs_central,
        min(a.final_pnl) OVER (PARTITION BY a.curve_id) AS min_pnl, max(a.final_pnl) OVER (PARTITION BY a.curve_id) AS max_pnl
       FROM ({FINALS}) a JOIN ({FINALS}) c ON a.curve_id = c.curve_id AND c.eta = 0.142e0""",
    "curve_id eta:f final_pnl:f delta_bps_vs_central:f min_pnl:f max_pnl:f", 4,
)
def _(v):
    return S.sensitivity_band(sweep(v), param="eta", central=0.142, capital=SMALL, keys=["curve_id"])


@query(
    "dq_sensitivity",
    """SELECT fund, problem FROM (
      SELECT l_suppkey AS fund, 'central_missing' AS problem FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_discount = 0.05e0) = 0
      UNION ALL SELECT l_suppkey, 'value_repeated' FROM lineitem GROUP BY 1 HAVING count(*) <> count(DISTINCT l_discount)
      UNION ALL SELECT l_suppkey, 'l_linestatus_differs' FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1)""",
)
def _(v):
    rows = v.table("lineitem").select(F.col("l_suppkey").alias("fund"), "l_discount", "l_linestatus")
    return S.dq_sensitivity(rows, param="l_discount", central=0.05, same=["l_linestatus"], keys=["fund"])


def day_positions(v):
    w = v.bars.select((F.col("asset_id") % 4).alias("curve_id"), "dt", "asset_id", "volume")
    return w.select("curve_id", "dt", "asset_id", (F.col("volume") % 50 - 20).cast("double").alias("shares"))


POSITIONS = "(SELECT asset_id % 4 AS curve_id, dt, asset_id, CAST(volume % 50 - 20 AS DOUBLE) AS shares FROM bars)"


@query(
    "dividend_income",
    f"""SELECT curve_id, dt, sum(coalesce(before, 0) * div) AS income FROM (
       SELECT p.*, lag(shares) OVER (PARTITION BY asset_id ORDER BY dt) AS before FROM {POSITIONS} p) p
       JOIN (SELECT asset_id AS aid, ex_date, sum(amount_per_share) AS div FROM dividends GROUP BY 1, 2) d ON d.aid = p.asset_id AND d.ex_date = p.dt GROUP BY 1, 2""",
    "curve_id dt:d income:f",
)
def _(v):
    return P.dividend_income(day_positions(v), v.dividends)


def held_late(v):
    """Positions on the month ends after each bar month: some have no bar that day."""
    return v.requests.select(
        (F.col("asset_id") % 4).alias("curve_id"), "dt", "asset_id", (F.col("asset_id") % 7 - 2).cast("double").alias("shares")
    )


HELD = "(SELECT asset_id % 4 AS curve_id, dt, asset_id, CAST(asset_id % 7 - 2 AS DOUBLE) AS shares FROM requests)"


def cash_of(v):
    return held_late(v).select("curve_id", "dt").distinct().withColumn("cash", F.lit(1000.0) + F.col("curve_id"))


@query(
    "mark_to_market",
    f"""SELECT p.curve_id, p.dt, 1000e0 + p.curve_id + coalesce(sum(shares * closeunadj) FILTER (WHERE shares <> 0), 0) AS nav,
        count(*) FILTER (WHERE shares <> 0 AND closeunadj IS NULL) AS n_unpriced,
        CASE WHEN count(*) FILTER (WHERE shares <> 0 AND closeunadj IS NULL) > 0 THEN 'unpriced' ELSE 'ok' END AS status
       FROM {HELD} p LEFT JOIN bars b ON b.asset_id = p.asset_id AND b.dt = p.dt GROUP BY 1, 2""",
    "curve_id dt:d nav:f n_unpriced status",
)
def _(v):
    return P.mark_to_market(held_late(v), cash_of(v), v.bars, on_missing="flag")


@query(
    "mark_to_market_carry",
    f"""SELECT p.curve_id, p.dt, 1000e0 + p.curve_id + coalesce(sum(shares * closeunadj), 0) AS nav, count(*) FILTER (WHERE shares <> 0 AND closeunadj IS NULL) AS n_unpriced
       FROM {HELD} p ASOF LEFT JOIN bars b ON b.asset_id = p.asset_id AND p.dt >= b.dt GROUP BY 1, 2""",
    "curve_id dt:d nav:f n_unpriced",
)
def _(v):
    return P.mark_to_market(held_late(v), cash_of(v), v.bars, on_missing="carry")


@query(
    "curve_summary",
    f"""SELECT c.curve_id, final_nav, final_nav - 1e6 AS final_pnl, n_days, n_rebalances FROM (
       SELECT curve_id, arg_max(nav, dt) AS final_nav, count(*) AS n_days FROM ({NAV}) GROUP BY 1) c
       JOIN (SELECT curve_id, count(DISTINCT dt) AS n_rebalances FROM {WEIGHTS} GROUP BY 1) r ON r.curve_id = c.curve_id""",
    "curve_id final_nav:f final_pnl:f n_days n_rebalances", 4,
)
def _(v):
    w = curve_weights(v)
    return P.curve_summary(P.portfolio_nav(w, v.bars, v.dividends, capital=CAPITAL), w, capital=CAPITAL)


@query(
    "diff_curves",
    """SELECT curve_id, 0.5e0 AS max_abs_diff, CAST(2 * count(*) FILTER (WHERE day(dt) = 13) AS BIGINT) AS n_unmatched, false AS agrees FROM asset_curves GROUP BY 1""",
    "curve_id max_abs_diff:f n_unmatched agrees",
)
def _(v):
    moved = F.when(F.dayofmonth("dt") == 13, F.add_months("dt", 1200)).otherwise(F.col("dt"))
    other = v.asset_curves.withColumn("dt", moved).withColumn("nav", F.col("nav") + 0.5)
    return P.diff_curves(v.asset_curves, other, tolerance=1e-4)
