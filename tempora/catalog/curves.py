"""Registered queries: curve statistics and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog import math_sql as X
from tempora.catalog.present import wrap
from tempora.catalog.view_sql import with_views
from tempora.functions import normal as N
from tempora.operators import curves as C
from tempora.operators import resample as RS

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


def returns_of(v):
    return C.curve_returns(v.asset_curves)


@query("curve_returns", "SELECT curve_id, dt, r FROM curve_returns", "curve_id dt:d r:f", 9)
def _(v):
    return returns_of(v).select("curve_id", "dt", "r")


@query("sharpe", "SELECT curve_id, n, mu AS mean_r, sd AS std_r, sr_hat, 'ok' AS status FROM curve_moments", "curve_id n mean_r:f std_r:f sr_hat:f status")
def _(v):
    return C.sharpe(returns_of(v), curves=v.asset_curves)


HOURLY_R = "(SELECT curve_id, dt, nav / lag(nav) OVER (PARTITION BY curve_id ORDER BY dt) - 1 AS r FROM hourly_curves)"


@query(
    "sharpe_hourly",
    f"SELECT curve_id, count(r) AS n, avg(r) AS mean_r, stddev_samp(r) AS std_r, avg(r) / stddev_samp(r) AS sr_hat, 'ok' AS status FROM {HOURLY_R} GROUP BY 1",
    "curve_id n mean_r:f std_r:f sr_hat:f status",
)
def _(v):
    return C.sharpe(C.curve_returns(v.hourly_curves), curves=v.hourly_curves)


@query("moments", "SELECT curve_id, gamma_3, gamma_4 FROM curve_moments", "curve_id gamma_3:f gamma_4:f")
def _(v):
    return C.moments(returns_of(v))


def stats_of(v):
    r = returns_of(v)
    return C.sharpe(r).join(C.moments(r), "curve_id")


Z0 = f"(SELECT *, {X.z_score('sr_hat', '0e0', 'n', 'gamma_3', 'gamma_4')} AS z FROM curve_moments)"
ZN = f"(SELECT *, {X.z_score('sr_hat', 'star', 'n', 'gamma_3', 'gamma_4')} AS z FROM (SELECT *, {X.benchmark('0.0004e0', 30)} AS star FROM curve_moments))"
ALPHA_Z = X.quantile("0.95e0")
MINTRL = f"CASE WHEN sr_hat > 0 THEN 1e0 + {X.variance('sr_hat', 'gamma_3', 'gamma_4')} * power({ALPHA_Z} / sr_hat, 2e0) END"


@query("psr", f"SELECT curve_id, {X.cdf('z')} AS psr FROM {Z0}", "curve_id psr:f", 8)
def _(v):
    s = stats_of(v)
    return s.select("curve_id", N.psr(F.col("sr_hat"), F.lit(0.0), F.col("n"), F.col("gamma_3"), F.col("gamma_4")).alias("psr"))


@query("dsr", f"SELECT curve_id, {X.cdf('z')} AS dsr FROM {ZN}", "curve_id dsr:f", 8)
def _(v):
    s = stats_of(v)
    value = N.dsr(F.col("sr_hat"), F.col("n"), F.col("gamma_3"), F.col("gamma_4"), F.lit(0.0004), F.lit(30))
    return s.select("curve_id", value.alias("dsr"))


@query("min_trl", f"SELECT curve_id, {MINTRL} AS min_trl FROM curve_moments", "curve_id min_trl:f", 4)
def _(v):
    s = stats_of(v)
    return s.select("curve_id", N.min_trl(F.col("sr_hat"), F.lit(0.0), 0.05, F.col("gamma_3"), F.col("gamma_4")).alias("min_trl"))


def peaks(view: str) -> str:
    return f"(SELECT *, max(nav) OVER (PARTITION BY curve_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM {view})"


@query("max_drawdown", f"SELECT curve_id, -min((nav - peak) / peak) AS max_drawdown, 'ok' AS status FROM {peaks('asset_curves')} GROUP BY 1", "curve_id max_drawdown:f status")
def _(v):
    return C.max_drawdown(v.asset_curves)


@query("max_drawdown_hourly", f"SELECT curve_id, -min((nav - peak) / peak) AS max_drawdown, 'ok' AS status FROM {peaks('hourly_curves')} GROUP BY 1", "curve_id max_drawdown:f status")
def _(v):
    return C.max_drawdown(v.hourly_curves)


def duration_sql(view: str) -> str:
    return f"""WITH p AS (SELECT *, nav < peak AS wet, lag(dt) OVER (PARTITION BY curve_id ORDER BY dt) AS pd FROM {peaks(view)}),
    q AS (SELECT *, sum(CASE WHEN wet THEN 0 ELSE 1 END) OVER (PARTITION BY curve_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM p),
    r AS (SELECT curve_id, run, count(*) AS bars, min(dt) AS s, max(dt) AS e, arg_min(pd, dt) AS peak_dt FROM q WHERE wet GROUP BY 1, 2),
    b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY curve_id ORDER BY bars DESC, s) = 1),
    t AS (SELECT q.curve_id, q.dt AS trough_dt FROM q JOIN b ON b.curve_id = q.curve_id AND b.run = q.run WHERE q.wet
          QUALIFY row_number() OVER (PARTITION BY q.curve_id ORDER BY q.nav, q.dt) = 1)
    SELECT c.curve_id, coalesce(bars, 0) AS duration_bars, coalesce(e = hi, false) AS censored, coalesce(peak_dt, lo) AS peak_dt, trough_dt
    FROM (SELECT curve_id, min(dt) AS lo, max(dt) AS hi FROM {view} GROUP BY 1) c LEFT JOIN b ON b.curve_id = c.curve_id LEFT JOIN t ON t.curve_id = c.curve_id"""


@query("drawdown_duration", duration_sql("asset_curves"), "curve_id duration_bars censored peak_dt:d trough_dt:d")
def _(v):
    return C.drawdown_duration(v.asset_curves)


@query("drawdown_duration_hourly", duration_sql("hourly_curves"), "curve_id duration_bars censored peak_dt:ts trough_dt:ts")
def _(v):
    return C.drawdown_duration(v.hourly_curves)


ENDS = "(SELECT curve_id, count(*) AS n_bars, arg_min(nav, dt) AS f, arg_max(nav, dt) AS l FROM asset_curves GROUP BY 1)"


@query(
    "calmar",
    f"""SELECT e.curve_id, (power(l / f, 252e0 / (n_bars - 1)) - 1) / dd AS calmar, 'ok' AS status FROM {ENDS} e
    JOIN (SELECT curve_id, -min((nav - peak) / peak) AS dd FROM {peaks('asset_curves')} GROUP BY 1) d ON d.curve_id = e.curve_id""",
    "curve_id calmar:f status",
)
def _(v):
    return C.calmar(v.asset_curves)


@query(
    "hhi",
    """SELECT curve_id, sum(pnl * pnl) / power(sum(abs(pnl)), 2e0) AS hhi, 'ok' AS status FROM (
       SELECT curve_id, nav - lag(nav) OVER (PARTITION BY curve_id ORDER BY dt) AS pnl FROM hourly_curves) GROUP BY 1""",
    "curve_id hhi:f status",
)
def _(v):
    from tempora.plans.running import auto_block, running

    h = v.hourly_curves
    p = running(h, keys=["curve_id"], order=["dt"], exprs={"before": ("lag", "nav")}, block=auto_block(h, "dt"))
    return C.hhi(p.withColumn("pnl", F.col("nav") - F.col("before")))


def runs_sql(returns: str) -> str:
    return f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY dt) - row_number() OVER (PARTITION BY curve_id, sign(r) ORDER BY dt) AS grp FROM {returns} x WHERE r IS NOT NULL),
    g AS (SELECT curve_id, sign(r) AS sg, grp, count(*) AS len FROM s GROUP BY 1, 2, 3)
    SELECT curve_id, coalesce(max(len) FILTER (WHERE sg > 0), 0) AS longest_win, coalesce(max(len) FILTER (WHERE sg < 0), 0) AS longest_loss FROM g GROUP BY 1"""


@query("longest_runs", runs_sql("curve_returns"))
def _(v):
    return C.longest_runs(returns_of(v))


@query("longest_runs_hourly", runs_sql(HOURLY_R))
def _(v):
    return C.longest_runs(C.curve_returns(v.hourly_curves))


@query("by_year", "SELECT curve_id, year(dt) AS year, arg_max(nav, dt) / arg_min(nav, dt) - 1 AS year_return FROM asset_curves GROUP BY 1, 2", "curve_id year:i year_return:f")
def _(v):
    return C.by_year(v.asset_curves)


@query(
    "performance",
    f"""SELECT e.curve_id, l / f - 1 AS total_return, power(l / f, 252e0 / (n_bars - 1)) - 1 AS annualized_return, sd * sqrt(252e0) AS annualized_volatility
    FROM {ENDS} e JOIN curve_moments m ON m.curve_id = e.curve_id""",
    "curve_id total_return:f annualized_return:f annualized_volatility:f",
)
def _(v):
    return C.performance(v.asset_curves)


CARD = f"""SELECT z.curve_id, 'ok' AS status, e.n_bars, e.start_dt, e.end_dt, l / f - 1 AS total_return, power(l / f, 252e0 / (e.n_bars - 1)) - 1 AS annualized_return,
    sd * sqrt(252e0) AS annualized_volatility, dd AS max_drawdown, duration_bars, censored, peak_dt, trough_dt, longest_win, longest_loss, sr_hat,
    {X.cdf('z.z')} AS psr, {X.cdf('y.z')} AS dsr, CAST(ceil({MINTRL.replace('sr_hat', 'z.sr_hat').replace('gamma_', 'z.gamma_')}) AS BIGINT) AS min_trl
  FROM {Z0} z JOIN (SELECT curve_id, {X.z_score('sr_hat', 'star', 'n', 'gamma_3', 'gamma_4')} AS z FROM (
      SELECT *, CASE WHEN curve_id % 2 = 0 THEN {X.benchmark('0.0004e0', 30)} ELSE 0e0 END AS star FROM curve_moments)) y ON y.curve_id = z.curve_id
  JOIN (SELECT curve_id, count(*) AS n_bars, min(dt) AS start_dt, max(dt) AS end_dt, arg_min(nav, dt) AS f, arg_max(nav, dt) AS l FROM asset_curves GROUP BY 1) e ON e.curve_id = z.curve_id
  JOIN (SELECT curve_id, -min((nav - peak) / peak) AS dd FROM {peaks('asset_curves')} GROUP BY 1) d ON d.curve_id = z.curve_id
  JOIN ({duration_sql('asset_curves')}) u ON u.curve_id = z.curve_id JOIN ({runs_sql('curve_returns')}) s ON s.curve_id = z.curve_id"""


@query(
    "scorecard", CARD.replace("sr_hat,\n    (", "z.sr_hat AS sr_hat,\n    ("),
    """curve_id status n_bars start_dt:d end_dt:d total_return:f annualized_return:f annualized_volatility:f max_drawdown:f duration_bars censored peak_dt:d
       trough_dt:d longest_win longest_loss sr_hat:f psr:f dsr:f min_trl""",
)
def _(v):
    trials = v.asset_curves.select("curve_id").distinct().select(
        "curve_id", F.when(F.col("curve_id") % 2 == 0, 30).otherwise(1).alias("n_trials"), F.lit(0.0004).alias("v_sr")
    )
    return C.scorecard(v.asset_curves, trials=trials)


@query(
    "scorecard_sections",
    """SELECT c.curve_id, count(*) AS n_bars, arg_max(nav, dt) / arg_min(nav, dt) - 1 AS total_return, max(m.sr_hat) AS sr_hat, count(DISTINCT year(dt)) AS n_years
       FROM asset_curves c JOIN curve_moments m ON m.curve_id = c.curve_id GROUP BY 1""",
    "curve_id n_bars total_return:f sr_hat:f n_years",
)
def _(v):
    nested = C.sections(C.scorecard(v.asset_curves), C.by_year(v.asset_curves))
    return nested.select(
        "curve_id", "general.n_bars", "performance.total_return", "risk_adjusted.sr_hat", F.size("attribution.by_year").cast("long").alias("n_years")
    )


@query(
    "nearest_rank_percentiles",
    """WITH s AS (SELECT curve_id, r, row_number() OVER (PARTITION BY curve_id ORDER BY r) AS rk, count(*) OVER (PARTITION BY curve_id) AS n FROM curve_returns)
    SELECT curve_id, pct, n, r AS value, n < 30 AS low_sample, 'ok' AS status FROM s JOIN (SELECT unnest([0e0, 5e0, 50e0, 95e0, 100e0]) AS pct) p
      ON rk = greatest(1, CAST(ceil(pct / 100e0 * n) AS BIGINT))""",
    "curve_id pct:f n value:f low_sample status",
)
def _(v):
    return RS.nearest_rank(returns_of(v), keys=["curve_id"], value="r", pcts=[0, 5, 50, 95, 100])


@query(
    "nearest_rank_hot_group",
    """WITH s AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rk,
        count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, pct, n, x AS value, n < 30 AS low_sample, 'ok' AS status FROM s JOIN (SELECT unnest([10e0, 50e0, 90e0]) AS pct) p
      ON rk = greatest(1, CAST(ceil(pct / 100e0 * n) AS BIGINT))""",
    "l_returnflag pct:f n value:f low_sample status",
)
def _(v):
    return RS.nearest_rank(v.table("lineitem"), keys=["l_returnflag"], value="l_extendedprice", pcts=[10, 50, 90])


def monthly(v):
    from tempora.operators.returns import period_returns

    r = period_returns(v.asset_curves, v.month_ends).select("curve_id", "dt", "ret")
    return RS.indexed(r, keys=["curve_id"], order="dt").select("curve_id", "idx", "ret")


def weekly_hours(v):
    return v.hourly_returns


HSERIES = f"(SELECT curve_id, CAST(row_number() OVER (PARTITION BY curve_id ORDER BY dt) - 1 AS BIGINT) AS idx, r FROM {HOURLY_R} WHERE r IS NOT NULL)"
ACF = f"""SELECT x.curve_id, lag, coalesce(sum((x.r - m) * (y.r - m)), 0) / max(v) AS acf, max(n) AS n FROM {HSERIES} x
   JOIN (SELECT curve_id, avg(r) AS m, count(*) AS n, sum((r - mu) * (r - mu)) AS v FROM (SELECT *, avg(r) OVER (PARTITION BY curve_id) AS mu FROM {HSERIES}) GROUP BY 1) s ON s.curve_id = x.curve_id
   CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS lag) l JOIN {HSERIES} y ON y.curve_id = x.curve_id AND y.idx = x.idx + lag GROUP BY 1, 2"""


@query("autocorrelation", ACF, "curve_id lag:i acf:f n")
def _(v):
    return RS.autocorrelation(weekly_hours(v), keys=["curve_id"], value="r", max_lag=6)


@query(
    "block_length",
    f"SELECT curve_id, greatest(2e0, coalesce(max(lag) FILTER (WHERE abs(acf) > 2 / sqrt(n)), 1) + 1) AS block_length FROM ({ACF}) GROUP BY 1",
    "curve_id block_length:f",
)
def _(v):
    return RS.block_length(RS.autocorrelation(weekly_hours(v), keys=["curve_id"], value="r", max_lag=6), keys=["curve_id"])


def uniform_sql(tag: str) -> str:
    text = f"'7|' || curve_id || '|' || CAST(path AS VARCHAR) || '|' || CAST(idx AS VARCHAR) || '|{tag}'"
    return f"(CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) / 4503599627370496e0)"


PATHS = f"""SELECT b.curve_id, b.path, b.step, b.src AS idx, s.r FROM (
   SELECT curve_id, path, idx AS step, CAST((from_idx + idx - pos) % n AS BIGINT) AS src FROM (
     SELECT curve_id, path, idx, n, pos, first_value(CASE WHEN fresh THEN st END) OVER (PARTITION BY curve_id, path, pos ORDER BY idx) AS from_idx FROM (
       SELECT *, max(CASE WHEN fresh THEN idx END) OVER (PARTITION BY curve_id, path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos FROM (
         SELECT curve_id, path, idx, n, idx = 0 OR {uniform_sql('r')} < 1 / 4e0 AS fresh, CAST(floor({uniform_sql('s')} * n) AS BIGINT) AS st
         FROM (SELECT curve_id, idx, count(*) OVER (PARTITION BY curve_id) AS n FROM {HSERIES}) CROSS JOIN (SELECT unnest(range({{paths}})) AS path) p)))) b
   JOIN {HSERIES} s ON s.curve_id = b.curve_id AND s.idx = b.src"""


@query("stationary_bootstrap", PATHS.format(paths=5), "curve_id path:i step idx r:f", 9)
def _(v):
    return RS.stationary_bootstrap(weekly_hours(v), keys=["curve_id"], value="r", n_paths=5, block_length=4.0, seed=7)


def sharpe_sql(paths: int) -> str:
    low, mid, high = (-(-p * paths // 100) for p in (5, 50, 95))
    return f"""WITH s AS (SELECT curve_id, path, avg(r) / stddev_samp(r) AS sharpe FROM ({PATHS.format(paths=paths)}) GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY sharpe) AS rk FROM s)
    SELECT k.curve_id, max(sharpe) FILTER (WHERE rk = {low}) AS p5, max(sharpe) FILTER (WHERE rk = {mid}) AS p50, max(sharpe) FILTER (WHERE rk = {high}) AS p95,
      count(*) AS n_paths, max(realized) AS realized_sharpe
    FROM k JOIN (SELECT curve_id, avg(r) / stddev_samp(r) AS realized FROM {HSERIES} GROUP BY 1) z ON z.curve_id = k.curve_id GROUP BY 1"""


@query("bootstrap_sharpe", sharpe_sql(40), "curve_id p5:f p50:f p95:f n_paths realized_sharpe:f")
def _(v):
    return RS.bootstrap_sharpe_blocks(weekly_hours(v), keys=["curve_id"], value="r", n_paths=40, block_length=4.0, seed=7)


@query("bootstrap_sharpe_1000", sharpe_sql(1000), "curve_id p5:f p50:f p95:f n_paths realized_sharpe:f")
def _(v):
    return RS.bootstrap_sharpe_blocks(weekly_hours(v), keys=["curve_id"], value="r", n_paths=1000, block_length=4.0, seed=7)
