"""Registered queries: calendars and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog.present import wrap
from tempora.catalog.view_sql import with_views
from tempora.operators import calendar as C

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None, columns: str = ""):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = wrap(with_views(sql), columns) if columns else with_views(sql)
        return fn

    return add


def weekly(v):
    """A calendar with gaps: sessions on Mondays and Thursdays."""
    return v.calendar.filter(F.weekday("dt").isin(0, 3))


WEEK = "(SELECT dt FROM calendar WHERE isodow(dt) IN (1, 4))"
DAYS = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders)"


def order_days(v):
    return v.table("orders").select(F.to_date("o_orderdate").alias("dt")).distinct()


@query("calendar_from", "SELECT DISTINCT dt FROM bars", "dt:d")
def _(v):
    return C.calendar_from(v.bars)


@query("trading_days", "SELECT dt FROM calendar WHERE dt BETWEEN DATE '1996-12-18' AND DATE '1998-01-14'", "dt:d")
def _(v):
    return C.trading_days(v.calendar, "1997-01-01", "1997-12-31")


@query(
    "weekday_sessions",
    f"""SELECT CAST(d AS DATE) AS dt FROM (SELECT unnest(range((SELECT min(dt) FROM calendar), (SELECT max(dt) + 1 FROM calendar), INTERVAL 1 DAY)) AS d)
       WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT dt FROM {DAYS} WHERE day(dt) = 1)""",
    "dt:d",
)
def _(v):
    bounds = v.calendar.agg(F.min("dt").alias("start"), F.max("dt").alias("end"))
    return C.weekday_sessions(bounds, order_days(v).filter(F.dayofmonth("dt") == 1))


@query(
    "nth_session_after",
    f"""WITH w AS (SELECT dt, row_number() OVER (ORDER BY dt) AS rn FROM {WEEK})
    SELECT d.dt, (SELECT x.dt FROM w x WHERE x.rn = (SELECT min(rn) FROM w y WHERE y.dt > d.dt) + 4) AS shifted_dt FROM {DAYS} d""",
    "dt:d shifted_dt:d",
)
def _(v):
    return C.shift_sessions(order_days(v), weekly(v), 5)


@query("snap_backward", f"SELECT d.dt, (SELECT max(dt) FROM {WEEK} w WHERE w.dt <= d.dt) AS session_dt FROM {DAYS} d", "dt:d session_dt:d")
def _(v):
    return C.snap(order_days(v), weekly(v))


@query("snap_forward", f"SELECT d.dt, (SELECT min(dt) FROM {WEEK} w WHERE w.dt >= d.dt) AS session_dt FROM {DAYS} d", "dt:d session_dt:d")
def _(v):
    return C.snap(order_days(v), weekly(v), "forward")


@query("next_bar", f"SELECT d.dt, (SELECT min(dt) FROM {WEEK} w WHERE w.dt > d.dt) AS session_dt FROM {DAYS} d", "dt:d session_dt:d")
def _(v):
    return C.snap(order_days(v), weekly(v), "forward", inclusive=False)


@query("is_session", f"SELECT d.dt, d.dt IN (SELECT dt FROM {WEEK}) AS is_session FROM {DAYS} d", "dt:d is_session")
def _(v):
    return C.is_session(order_days(v), weekly(v))


@query("month_end_sessions", f"SELECT max(dt) AS dt FROM {WEEK} GROUP BY date_trunc('month', dt)", "dt:d")
def _(v):
    return C.month_end_sessions(weekly(v))


WINDOWS = f"""SELECT a.as_of, t.tag, (SELECT max(dt) FROM {WEEK} w WHERE w.dt <= raw) AS window_start,
    (SELECT max(dt) FROM {WEEK} w WHERE w.dt <= a.as_of) AS window_end FROM (
    SELECT as_of, tag, CASE tag WHEN '1y' THEN CAST(as_of - INTERVAL 1 YEAR AS DATE) WHEN '3y' THEN CAST(as_of - INTERVAL 3 YEAR AS DATE)
       WHEN '5y' THEN CAST(as_of - INTERVAL 5 YEAR AS DATE) ELSE (SELECT min(dt) FROM calendar) + 20 END AS raw
    FROM (SELECT DISTINCT last_day(dt) AS as_of FROM calendar), (SELECT unnest(['1y', '3y', '5y', 'si']) AS tag)) a
    JOIN (SELECT unnest(['1y', '3y', '5y', 'si']) AS tag) t ON a.tag = t.tag"""


@query("trailing_windows", WINDOWS, "as_of:d tag window_start:d window_end:d")
def _(v):
    inception = v.calendar.agg(F.date_add(F.min("dt"), 20)).scalar()
    as_ofs = v.calendar.select(F.last_day("dt").alias("as_of")).distinct().withColumn("inception", inception)
    return C.trailing_windows(as_ofs, ["1y", "3y", "5y", "si"], weekly(v)).select("as_of", "tag", "window_start", "window_end")


@query(
    "ny_close",
    f"""SELECT dt, timezone('UTC', timezone('America/New_York', dt + INTERVAL 16 HOUR)) AS close_utc FROM {DAYS}""",
    "dt:d close_utc:ts",
)
def _(v):
    return order_days(v).select("dt", C.ny_close(F.col("dt")).alias("close_utc"))


@query(
    "et_date",
    """SELECT event_id, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS et_day FROM events""",
    "event_id et_day:d",
)
def _(v):
    return v.table("events").select("event_id", C.et_date(F.col("ts")).alias("et_day"))
