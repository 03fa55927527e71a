"""Session calendars.  A calendar is a table with one DATE column `dt`.

Windows here run over distinct days, so even without a key they hold at most one row
per day of history.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.returns import TAG_YEARS
from tempora.plans.asof import asof_join


def calendar_from(bars: DataFrame, *, at: str = "dt") -> DataFrame:
    """Distinct session dates of a table."""
    return bars.select(F.col(at).cast("date").alias("dt")).distinct()


def trading_days(calendar: DataFrame, start: str | _dt.date, end: str | _dt.date, *, pad_days: int = 14) -> DataFrame:
    """Sessions in [start - pad, end + pad]."""
    lo, hi = F.date_sub(F.lit(start).cast("date"), pad_days), F.date_add(F.lit(end).cast("date"), pad_days)
    return calendar.select("dt").distinct().filter(F.col("dt").between(lo, hi))


def weekday_sessions(bounds: DataFrame, holidays: DataFrame) -> DataFrame:
    """Monday-to-Friday dates of the (start, end) rows that are not in a holiday table."""
    days = bounds.select(F.explode(F.sequence("start", "end")).alias("dt")).distinct()
    return days.filter(F.weekday("dt") < 5).join(holidays.select("dt"), "dt", "left_anti")


def numbered(calendar: DataFrame) -> DataFrame:
    """Sessions with their position, counting from 1."""
    return calendar.select("dt").distinct().withColumn("session_no", F.row_number().over(Window.orderBy("dt")))


def shift_sessions(dates: DataFrame, calendar: DataFrame, n: int, *, at: str = "dt", out: str = "shifted_dt") -> DataFrame:
    """The n-th session strictly after each date (n >= 1); NULL beyond the calendar."""
    if n < 1:
        raise ValueError(f"n must be >= 1, got {n}")
    ahead = calendar.select("dt").distinct().select(
        F.col("dt").alias("__d"), F.lead("dt", n - 1).over(Window.orderBy("dt")).alias(out)
    )
    return asof_join(
        dates, ahead, by=[], left_ts=at, right_ts="__d", payload=[out], direction="forward", inclusive=False, right_unique=True
    )


def snap(dates: DataFrame, calendar: DataFrame, direction: str = "backward", *, at: str = "dt", inclusive: bool = True,
         out: str = "session_dt") -> DataFrame:
    """Nearest session on or before (backward) / on or after (forward) each date.

    `inclusive=False` with forward gives the next session strictly after the date.
    """
    right = calendar.select(F.col("dt").alias("__d"), F.col("dt").alias(out))
    return asof_join(dates, right, by=[], left_ts=at, right_ts="__d", payload=[out], direction=direction, inclusive=inclusive)


def is_session(dates: DataFrame, calendar: DataFrame, *, at: str = "dt") -> DataFrame:
    days = calendar.select(F.col("dt").alias(at)).distinct().withColumn("__s", F.lit(True))
    return dates.join(days, at, "left").select(*dates.columns, F.coalesce("__s", F.lit(False)).alias("is_session"))


def month_end_sessions(calendar: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Last session of each calendar month present (inside an optional range)."""
    days = calendar
    if start is not None:
        days = days.filter(F.col("dt") >= F.lit(start).cast("date"))
    if end is not None:
        days = days.filter(F.col("dt") <= F.lit(end).cast("date"))
    return days.groupBy(F.trunc("dt", "month").alias("__m")).agg(F.max("dt").alias("dt")).select("dt")


def trailing_start(as_of: Column, tag: Column, inception: Column) -> Column:
    """as_of minus the tag's years (month ends are clipped), or the inception date."""
    out = F.when(tag == "si", inception)
    for name, years in TAG_YEARS.items():
        out = out.when(tag == name, F.add_months(as_of, -12 * years))
    return out


def trailing_windows(as_ofs: DataFrame, tags: list[str], calendar: DataFrame, *, as_of: str = "as_of",
                     inception: str = "inception") -> DataFrame:
    """Rows x tags with the snapped window start and end."""
    bad = [t for t in tags if t != "si" and t not in TAG_YEARS]
    if bad:
        raise ValueError(f"unknown period tags {bad}; expected {[*TAG_YEARS, 'si']}")
    tagged = as_ofs.withColumn("tag", F.explode(F.array(*[F.lit(t) for t in tags])))
    raw = tagged.withColumn("raw_start", trailing_start(F.col(as_of), F.col("tag"), F.col(inception)))
    started = snap(raw, calendar, at="raw_start", out="window_start")
    return snap(started, calendar, at=as_of, out="window_end")


def ny_close(day: Column) -> Column:
    """The instant of 16:00 New York time on a date."""
    local = day.cast("timestamp_ntz") + F.expr("interval 16 hours")
    return F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), local).cast("timestamp")


def et_date(instant: Column, *, aware: bool = True) -> Column:
    """New York calendar date of an instant; a naive value is already New York time."""
    if not aware:
        return instant.cast("date")
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), instant.cast("timestamp_ntz")).cast("date")
