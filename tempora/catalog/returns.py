"""Registered queries: return series, reconciliation, momentum, survivorship."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog.dates import WEEK, weekly
from tempora.catalog.present import wrap
from tempora.catalog.view_sql import with_views
from tempora.operators import momentum as MO
from tempora.operators import reconcile as RC
from tempora.operators import returns as R
from tempora.operators import survivorship as SV

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None, columns: str = "", digits: int = 6):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = wrap(with_views(sql), columns, digits) if columns else with_views(sql)
        return fn

    return add


def splits_of(v):
    return v.actions.filter(F.col("action") == "split").select("asset_id", F.col("date").alias("ex_date"), F.col("value").alias("ratio"))


def schedule_of(v):
    """A fee schedule derived from region: one step every 500 days from 1994 on."""
    return v.table("region").select(
        F.expr("date_add(date'1994-06-01', cast(r_regionkey * 500 as int))").alias("effective_from"),
        (F.lit(0.0012) - F.lit(0.0001) * F.col("r_regionkey")).alias("rate"),
    )


SCHEDULE = "(SELECT DATE '1994-06-01' + CAST(r_regionkey * 500 AS INTEGER) AS effective_from, 0.0012e0 - 0.0001e0 * r_regionkey AS rate FROM region)"


@query("total_return", "SELECT asset_id, dt, tr, daily_return FROM total_return", "asset_id dt:d tr:f daily_return:f", 9)
def _(v):
    return R.total_return(v.bars, v.dividends)


QUERIES["total_return"].digits = 9


@query(
    "total_return_with_drag",
    """SELECT asset_id, dt, product(CASE WHEN rn = 1 THEN 1e0 ELSE m * (1e0 - 0.000945e0 / 252) END)
         OVER (PARTITION BY asset_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tr
       FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY dt) AS rn FROM multipliers)""",
    "asset_id dt:d tr:f",
)
def _(v):
    return R.total_return(v.bars, v.dividends, drag=0.000945 / 252).select("asset_id", "dt", "tr")


@query(
    "step_rate",
    f"""SELECT c.dt, s.rate, s.rate / 252 AS daily_drag, CASE WHEN s.rate IS NULL THEN 'before_schedule' ELSE 'ok' END AS status
    FROM (SELECT dt - 300 AS dt FROM calendar) c ASOF LEFT JOIN {SCHEDULE} s ON c.dt >= s.effective_from""",
    "dt:d rate:f daily_drag:f status",
)
def _(v):
    return R.step_rate(v.calendar.select(F.date_sub("dt", 300).alias("dt")), schedule_of(v))


@query(
    "annualize_252",
    """SELECT asset_id, count(*) AS n_days, power(arg_max(tr, dt) / arg_min(tr, dt), 252e0 / (count(*) - 1)) - 1 AS annualized_return, 'ok' AS status
       FROM total_return GROUP BY 1 HAVING count(*) > 1""",
    "asset_id n_days annualized_return:f status",
)
def _(v):
    return R.annualize_252(R.total_return(v.bars, v.dividends))


_NOMINAL = """CASE tag WHEN '1y' THEN {g} - 1 WHEN '3y' THEN power({g}, 1e0 / 3) - 1 WHEN '5y' THEN power({g}, 1e0 / 5) - 1
   WHEN '10y' THEN power({g}, 1e0 / 10) - 1 ELSE power({g}, 365.25e0 / {d}) - 1 END"""
_TAGS = "(SELECT unnest(['1y', '3y', '5y', '10y', 'si']) AS tag)"


@query(
    "annualize_nominal",
    f"""SELECT asset_id, tag, {_NOMINAL.format(g='g', d='d')} AS annualized_return
    FROM (SELECT asset_id, arg_max(tr, dt) AS g, max(dt) - min(dt) AS d FROM total_return GROUP BY 1) CROSS JOIN {_TAGS}""",
    "asset_id tag annualized_return:f",
)
def _(v):
    ends = R.total_return(v.bars, v.dividends).groupBy("asset_id").agg(
        F.max_by("tr", "dt").alias("g"), F.datediff(F.max("dt"), F.min("dt")).alias("d")
    )
    tagged = ends.withColumn("tag", F.explode(F.array(*[F.lit(t) for t in ("1y", "3y", "5y", "10y", "si")])))
    return tagged.select("asset_id", "tag", R.annualize_nominal(F.col("g"), F.col("tag"), F.col("d")).alias("annualized_return"))


_WINDOWS = f"""(SELECT asset_id, tag, as_of, (SELECT max(dt) FROM {WEEK} w WHERE w.dt <= raw) AS ws, (SELECT max(dt) FROM {WEEK} w WHERE w.dt <= as_of) AS we
   FROM (SELECT asset_id, as_of, tag, CASE tag WHEN '1y' THEN CAST(as_of - INTERVAL 1 YEAR AS DATE) WHEN '3y' THEN CAST(as_of - INTERVAL 3 YEAR AS DATE)
           WHEN '5y' THEN CAST(as_of - INTERVAL 5 YEAR AS DATE) WHEN '10y' THEN CAST(as_of - INTERVAL 10 YEAR AS DATE) ELSE first + 30 END AS raw
         FROM (SELECT asset_id, max(dt) - 60 AS as_of, min(dt) AS first FROM bars GROUP BY 1) CROSS JOIN {_TAGS}))"""
_REF = """(SELECT asset_id, tag, CASE WHEN asset_id % 9 = 8 THEN NULL ELSE round(g * 100, 2) / 100e0 + ((asset_id + t) % 5) * 0.0005e0 END AS published
   FROM (SELECT w.asset_id, w.tag, position(w.tag IN '1y3y5y10ysi') AS t, {nominal} AS g FROM {windows} w
     JOIN LATERAL (SELECT product(m) / arg_min(m, dt) AS gr, count(*) AS n FROM multipliers x WHERE x.asset_id = w.asset_id AND x.dt BETWEEN w.ws AND w.we) q ON true
     WHERE q.n > 0))""".format(nominal=_NOMINAL.replace("tag", "w.tag").format(g="q.gr", d="(w.we - w.ws)"), windows=_WINDOWS)
_RECON = f"""SELECT asset_id, tag, ws AS window_start, we AS window_end, CASE WHEN why IS NULL THEN ours END AS engine_return,
     CASE WHEN why IS NULL THEN published END AS published_return, CASE WHEN why IS NULL THEN (ours - published) * 1e4 END AS delta_bps,
     CASE WHEN why IS NULL THEN n END AS n_trading_days,
     CASE WHEN why IS NOT NULL THEN 'SKIPPED' WHEN abs((ours - published) * 1e4) <= tol THEN 'PASS' ELSE 'FAIL' END AS verdict, why AS skip_reason
   FROM (SELECT w.*, c.lo, c.hi, q.n, r.published, {_NOMINAL.replace('tag', 'w.tag').format(g='q.gr', d='(w.we - w.ws)')} AS ours,
       CASE w.tag WHEN '1y' THEN 25e0 WHEN '3y' THEN 8e0 WHEN '5y' THEN 7e0 WHEN '10y' THEN 15e0 ELSE 20e0 END AS tol,
       CASE WHEN w.ws IS NULL OR w.we IS NULL THEN 'calendar misses window' WHEN c.lo > w.ws OR c.hi < w.we THEN 'bars do not cover window'
            WHEN r.published IS NULL THEN 'no published figure' END AS why
     FROM {_WINDOWS} w JOIN (SELECT asset_id, min(dt) AS lo, max(dt) AS hi FROM bars GROUP BY 1) c ON c.asset_id = w.asset_id
     LEFT JOIN LATERAL (SELECT product(m) / arg_min(m, dt) AS gr, count(*) AS n FROM multipliers x WHERE x.asset_id = w.asset_id AND x.dt BETWEEN w.ws AND w.we) q ON true
     LEFT JOIN {_REF} r ON r.asset_id = w.asset_id AND r.tag = w.tag)"""
_TAG_POS = {"1y": 1, "3y": 3, "5y": 5, "10y": 7, "si": 10}


def _as_ofs(v):
    return v.bars.groupBy("asset_id").agg(F.date_sub(F.max("dt"), 60).alias("as_of"), F.date_add(F.min("dt"), 30).alias("inception"))


def _reference(v):
    """Published figures: our own rounded to a basis point plus 0 to 20 bps per tag."""
    every = v.bars.select("asset_id").distinct().select(
        "asset_id", F.explode(F.array(*[F.lit(t) for t in RC.TOLERANCE_BPS])).alias("period"), F.lit(0.0).alias("annualized_nav_tr")
    )
    ours = RC.reconcile(v.bars, v.dividends, every, _as_ofs(v).withColumn("as_of", F.col("as_of")), weekly(v))
    pos = F.create_map(*[x for t, n in _TAG_POS.items() for x in (F.lit(t), F.lit(n))])[F.col("tag")]
    return ours.filter(F.col("engine_return").isNotNull() & (F.col("asset_id") % 9 != 8)).select(
        "asset_id", F.col("tag").alias("period"),
        (F.round(F.col("engine_return") * 100, 2) / 100.0 + ((F.col("asset_id") + pos) % 5) * 0.0005).alias("annualized_nav_tr"),
    )


@query(
    "reconcile_trailing", _RECON,
    "asset_id tag window_start:d window_end:d engine_return:f published_return:f delta_bps:f n_trading_days verdict skip_reason", 5,
)
def _(v):
    return RC.reconcile(v.bars, v.dividends, _reference(v), _as_ofs(v), weekly(v))


QUERIES["reconcile_trailing"].digits = 5


@query(
    "overall_verdict",
    f"""SELECT asset_id, CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(verdict = 'PASS') THEN 'PASS' ELSE 'NEEDS_DATA' END AS overall_verdict
    FROM ({_RECON}) GROUP BY 1""",
)
def _(v):
    return RC.verdict(RC.reconcile(v.bars, v.dividends, _reference(v), _as_ofs(v), weekly(v)))


def _other_dividends(v):
    """A second source: every fifth day of the month is booked a day later, amounts differ."""
    moved = F.when(F.dayofmonth("ex_date") % 5 == 0, F.date_add("ex_date", 1)).otherwise(F.col("ex_date"))
    return v.dividends.select("asset_id", moved.alias("ex_date"), (F.col("amount_per_share") + 0.001).alias("amount_per_share"))


_OTHER = """(SELECT asset_id, CASE WHEN day(ex_date) % 5 = 0 THEN ex_date + 1 ELSE ex_date END AS ex_date, amount_per_share + 0.001e0 AS amount_per_share
   FROM dividends)"""
_DIFF = f"""SELECT coalesce(a.asset_id, b.asset_id) AS asset_id, coalesce(a.ex_date, b.ex_date) AS ex_date, a.amount_per_share AS ours_amount,
   b.amount_per_share AS theirs_amount, a.amount_per_share - b.amount_per_share AS delta
   FROM dividends a FULL OUTER JOIN {_OTHER} b ON a.asset_id = b.asset_id AND a.ex_date = b.ex_date"""


@query("diff_dividends", _DIFF, "asset_id ex_date:d ours_amount:f theirs_amount:f delta:f")
def _(v):
    return RC.diff_dividends(v.dividends, _other_dividends(v))


@query(
    "dividend_totals",
    f"SELECT asset_id, coalesce(sum(ours_amount), 0) AS ours_total, coalesce(sum(theirs_amount), 0) AS theirs_total FROM ({_DIFF}) GROUP BY 1",
    "asset_id ours_total:f theirs_total:f",
)
def _(v):
    return RC.dividend_totals(RC.diff_dividends(v.dividends, _other_dividends(v)))


_DRIFT = f"""WITH f AS (SELECT m.asset_id, m.dt, m.m AS g, CASE WHEN rn = 1 THEN 1e0 ELSE m.m * (1e0 - s.rate / 252) END AS d,
     CASE WHEN rn = 1 THEN 1e0 ELSE closeunadj / prev END AS p
   FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY dt) AS rn, lag(closeunadj) OVER (PARTITION BY asset_id ORDER BY dt) AS prev FROM multipliers) m
   ASOF LEFT JOIN {SCHEDULE} s ON m.dt >= s.effective_from),
 w AS (SELECT asset_id, ws, we, (SELECT max(dt) FROM {WEEK} x WHERE x.dt < ws) AS ss FROM {_WINDOWS} WHERE tag = '1y'),
 a AS (SELECT w.asset_id, product(g) / arg_min(g, dt) AS g, product(d) / arg_min(d, dt) AS d, product(p) / arg_min(p, dt) AS p, count(*) AS n
       FROM w JOIN f ON f.asset_id = w.asset_id AND f.dt BETWEEN w.ws AND w.we GROUP BY 1),
 b AS (SELECT w.asset_id, product(d) / arg_min(d, dt) AS d, count(*) AS n FROM w JOIN f ON f.asset_id = w.asset_id AND f.dt BETWEEN w.ss AND w.we GROUP BY 1),
 t AS (SELECT a.asset_id, v.variant, CASE v.variant WHEN 'with_drag' THEN power(a.d, 252e0 / (a.n - 1)) - 1 WHEN 'gross' THEN power(a.g, 252e0 / (a.n - 1)) - 1
    WHEN 'price_only' THEN power(a.p, 252e0 / (a.n - 1)) - 1 WHEN 'shifted_anchor' THEN power(b.d, 252e0 / (b.n - 1)) - 1
    WHEN 'period_return' THEN a.d - 1 ELSE b.d - 1 END AS value
   FROM a JOIN b ON a.asset_id = b.asset_id CROSS JOIN (SELECT unnest(['with_drag', 'gross', 'price_only', 'shifted_anchor', 'period_return', 'shifted_period_return']) AS variant) v)
SELECT t.asset_id, variant, value, (value - asset_id % 7 / 100e0) * 1e4 AS delta_bps FROM t"""


@query("drift_attribution", _DRIFT, "asset_id variant value:f delta_bps:f", 5)
def _(v):
    from tempora.operators.calendar import trailing_windows

    windows = trailing_windows(_as_ofs(v), ["1y"], weekly(v)).select("asset_id", "window_start", "window_end")
    reference = v.bars.select("asset_id").distinct().withColumn("annualized_nav_tr", F.col("asset_id") % 7 / 100.0)
    return RC.drift_attribution(v.bars, v.dividends, schedule_of(v), windows, reference, weekly(v))


QUERIES["drift_attribution"].digits = 5

_FACTOR = """SELECT b.asset_id, b.dt, closeunadj, coalesce(product(s.value), 1e0) AS factor FROM bars b
   LEFT JOIN actions s ON s.asset_id = b.asset_id AND s.action = 'split' AND s.date > b.dt {more} GROUP BY 1, 2, 3"""


@query("split_factor", _FACTOR.format(more=""), "asset_id dt:d closeunadj:f factor:f")
def _(v):
    return R.split_factor(v.bars, splits_of(v)).select("asset_id", "dt", "closeunadj", "factor")


@query(
    "adjust_dividends",
    f"""SELECT d.asset_id, d.ex_date, amount_per_share, coalesce(f.factor, 1e0) AS factor, amount_per_share / coalesce(f.factor, 1e0) AS adjusted_amount
    FROM {_OTHER} d ASOF LEFT JOIN ({_FACTOR.format(more="")}) f ON d.asset_id = f.asset_id AND d.ex_date >= f.dt""",
    "asset_id ex_date:d amount_per_share:f factor:f adjusted_amount:f",
)
def _(v):
    return R.adjust_dividends(_other_dividends(v), R.split_factor(v.bars, splits_of(v)))


@query(
    "adjusted_close",
    f"SELECT asset_id, dt, closeunadj / factor AS adjusted_close FROM ({_FACTOR.format(more="AND s.date <= DATE '1999-06-30'")}) WHERE dt <= DATE '1999-06-30'",
    "asset_id dt:d adjusted_close:f",
)
def _(v):
    return R.adjusted_close(v.bars, splits_of(v), perspective="1999-06-30")


@query(
    "last_bar_on_or_before",
    "SELECT r.asset_id, r.dt - 7 AS target, (SELECT max(dt) FROM bars b WHERE b.asset_id = r.asset_id AND b.dt <= r.dt - 7) AS bar_dt FROM requests r",
    "asset_id target:d bar_dt:d",
)
def _(v):
    return R.last_bar_on_or_before(v.requests.select("asset_id", F.date_sub("dt", 7).alias("target")), v.bars)


_MOM = """WITH req AS (
   SELECT m.dt, m.asset_id FROM (SELECT d.dt, m.asset_id FROM (SELECT DISTINCT dt FROM month_ends) d JOIN membership m
     ON m.snapshot_date = (SELECT max(snapshot_date) FROM membership x WHERE x.snapshot_date <= d.dt)) m
   WHERE (SELECT count(*) FROM securities s WHERE s.permaticker = m.asset_id AND s.firstpricedate <= m.dt AND (s.lastpricedate IS NULL OR s.lastpricedate >= m.dt)) = 1),
 edges AS (SELECT r.dt, r.asset_id, (SELECT max(b.dt) FROM bars b WHERE b.asset_id = r.asset_id AND b.dt <= CAST(r.dt - INTERVAL 12 MONTH AS DATE)) AS f,
     (SELECT max(b.dt) FROM bars b WHERE b.asset_id = r.asset_id AND b.dt <= CAST(r.dt - INTERVAL 1 MONTH AS DATE)) AS n FROM req r),
 sp AS (SELECT b.asset_id, b.dt, coalesce(product(s.value), 1e0) AS ratio FROM (
     SELECT asset_id, dt, lag(dt) OVER (PARTITION BY asset_id ORDER BY dt) AS pdt FROM bars) b
   LEFT JOIN actions s ON s.asset_id = b.asset_id AND s.action = 'split' AND s.date > b.pdt AND s.date <= b.dt GROUP BY 1, 2)
SELECT e.dt, e.asset_id, exp(sum(CASE WHEN m.dt > e.f THEN ln(m.m * sp.ratio) ELSE 0 END)) - 1 AS score
FROM edges e JOIN multipliers m ON m.asset_id = e.asset_id AND m.dt BETWEEN e.f AND e.n JOIN sp ON sp.asset_id = m.asset_id AND sp.dt = m.dt
WHERE e.f < e.n GROUP BY 1, 2"""


@query("momentum_12_1", _MOM, "dt:d asset_id score:f")
def _(v):
    return MO.momentum(v.month_ends.select("dt"), v.membership, v.securities, v.bars, v.dividends, splits_of(v))


@query(
    "lookback_guard",
    "SELECT * FROM (SELECT r.asset_id, r.dt, (SELECT count(*) FROM bars b WHERE b.asset_id = r.asset_id AND b.dt < r.dt) AS n_prior FROM requests r) WHERE n_prior < 273",
    "asset_id dt:d n_prior",
)
def _(v):
    return MO.lookback_guard(v.requests, v.bars)


@query(
    "pct_change",
    "SELECT asset_id, dt, ret FROM returns_daily",
    "asset_id dt:d ret:f",
)
def _(v):
    return R.pct_change(v.bars, keys=["asset_id"], order="dt", value="closeunadj").select("asset_id", "dt", "ret")


@query(
    "period_returns",
    """SELECT * FROM (SELECT curve_id, dt, nav / lag(nav) OVER (PARTITION BY curve_id ORDER BY dt) - 1 AS ret FROM asset_curves
       WHERE dt IN (SELECT dt FROM month_ends)) WHERE ret IS NOT NULL""",
    "curve_id dt:d ret:f",
)
def _(v):
    return R.period_returns(v.asset_curves, v.month_ends).select("curve_id", "dt", "ret")


@query(
    "rolling_market_state",
    """SELECT asset_id, dt, CASE WHEN count(volume) OVER w >= 20 THEN avg(volume) OVER w END AS v_d,
         CASE WHEN count(ret) OVER w >= 20 THEN stddev_pop(ret) OVER w END AS sigma_d FROM returns_daily
       WINDOW w AS (PARTITION BY asset_id ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "asset_id dt:d v_d:f sigma_d:f",
)
def _(v):
    return R.rolling_market_state(v.bars).select("asset_id", "dt", "v_d", "sigma_d")


@query(
    "rolling_inclusive",
    """SELECT asset_id, dt, CASE WHEN count(volume) OVER w >= 60 THEN avg(volume) OVER w END AS v_d,
         CASE WHEN count(ret) OVER w >= 60 THEN stddev_pop(ret) OVER w END AS sigma_d FROM returns_daily
       WINDOW w AS (PARTITION BY asset_id ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    "asset_id dt:d v_d:f sigma_d:f",
)
def _(v):
    return R.rolling_market_state(v.bars, window=60, exclude_current=False).select("asset_id", "dt", "v_d", "sigma_d")


_COHORTS = """WITH win AS (SELECT max(dt) AS as_of, CAST(max(dt) - INTERVAL 3 YEAR AS DATE) AS pit_date FROM calendar),
 r AS (SELECT w.*, 'pit' AS cohort, w.pit_date AS rd FROM win w UNION ALL SELECT w.*, 'current', w.as_of FROM win w),
 mem AS (SELECT r.*, m.asset_id FROM r JOIN membership m ON m.snapshot_date = (SELECT max(snapshot_date) FROM membership x WHERE x.snapshot_date <= r.rd)),
 c AS (SELECT mem.*, (SELECT count(*) FROM securities s WHERE s.permaticker = mem.asset_id AND s.firstpricedate <= mem.pit_date
         AND (s.lastpricedate IS NULL OR s.lastpricedate >= mem.pit_date)) AS listed FROM mem),
 g AS (SELECT x.asset_id, exp(sum(ln(m))) / arg_min(m, dt) AS tr, count(*) AS n FROM multipliers x CROSS JOIN win WHERE x.dt BETWEEN win.pit_date AND win.as_of GROUP BY 1),
 t AS (SELECT c.pit_date, c.as_of, c.cohort, c.asset_id, CASE WHEN c.listed = 1 AND g.n >= 2 THEN g.tr END AS tr FROM c LEFT JOIN g ON g.asset_id = c.asset_id)"""


def _cohorts(v):
    windows = v.calendar.agg(F.max("dt").alias("as_of")).withColumn("pit_date", F.add_months("as_of", -36))
    return SV.cohort_returns(v.membership, v.securities, v.bars, v.dividends, windows)


@query(
    "survivorship_report",
    f"""{_COHORTS}, a AS (SELECT pit_date, as_of, date_diff('day', pit_date, as_of) / 365.25e0 AS years,
      count(*) FILTER (WHERE cohort = 'pit') AS pit_count, count(*) FILTER (WHERE cohort = 'current') AS current_count,
      count(tr) FILTER (WHERE cohort = 'pit') AS pit_priced, count(tr) FILTER (WHERE cohort = 'current') AS current_priced,
      avg(tr) FILTER (WHERE cohort = 'pit') AS pit_mean_tr, avg(tr) FILTER (WHERE cohort = 'current') AS current_mean_tr FROM t GROUP BY 1, 2)
    SELECT a.*, (SELECT count(*) FROM (SELECT asset_id FROM t WHERE cohort = 'pit' INTERSECT SELECT asset_id FROM t WHERE cohort = 'current')) AS survivor_count,
      (SELECT count(*) FROM (SELECT asset_id FROM t WHERE cohort = 'pit' EXCEPT SELECT asset_id FROM t WHERE cohort = 'current')) AS leaver_count,
      power(pit_mean_tr, 1 / years) - 1 AS pit_cagr, power(current_mean_tr, 1 / years) - 1 AS current_cagr,
      (power(current_mean_tr, 1 / years) - power(pit_mean_tr, 1 / years)) * 1e4 AS cagr_delta_bps FROM a""",
    """pit_date:d as_of:d years:f pit_count current_count pit_priced current_priced pit_mean_tr:f current_mean_tr:f survivor_count leaver_count
       pit_cagr:f current_cagr:f cagr_delta_bps:f""",
)
def _(v):
    return SV.survivorship(_cohorts(v))


@query(
    "survivorship_lists",
    f"""{_COHORTS} SELECT pit_date, as_of, asset_id, 'skipped_current' AS list FROM t WHERE cohort = 'current' AND tr IS NULL
    UNION ALL SELECT pit_date, as_of, asset_id, 'left_index' FROM t WHERE cohort = 'pit' AND asset_id NOT IN (SELECT asset_id FROM t WHERE cohort = 'current')""",
    "pit_date:d as_of:d asset_id list",
)
def _(v):
    return SV.survivorship_lists(_cohorts(v))
