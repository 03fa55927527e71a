"""Return series: total return, annualisation, rolling statistics, split factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.plans.asof import asof_join
from tempora.plans.running import rolling, rolling_moments, running

TRADING_DAYS_PER_YEAR = 252

# Nominal years of the trailing-window tags ("si" is from inception).
TAG_YEARS = {"1y": 1, "3y": 3, "5y": 5, "10y": 10}


def dividends_per_day(dividends: DataFrame, keys: Sequence[str], ex_date: str = "ex_date") -> DataFrame:
    """One row per (key, ex-date): several payments on a day add up."""
    return dividends.groupBy(*keys, ex_date).agg(F.sum("amount_per_share").alias("div"))


def multipliers(
    bars: DataFrame,
    dividends: DataFrame | None,
    *,
    keys: Sequence[str] = ("asset_id",),
    price: str = "closeunadj",
    drag: Column | float = 0.0,
    split_ratios: DataFrame | None = None,
) -> DataFrame:
    """(keys, dt, price, multiplier): one growth factor per bar, 1 after a NULL price.

    Each factor needs only the bar before it, so nothing here is cumulative.
    `split_ratios` (keys, dt, ratio) restates a bar's growth on the old share basis.
    """
    keys = list(keys)
    drag = drag if isinstance(drag, Column) else F.lit(float(drag))
    px = bars.select(*keys, "dt", F.col(price).alias("price"))
    if dividends is not None:
        px = px.join(dividends_per_day(dividends, keys).withColumnRenamed("ex_date", "dt"), keys + ["dt"], "left")
    else:
        px = px.withColumn("div", F.lit(0.0))
    if split_ratios is not None:
        px = px.join(split_ratios, keys + ["dt"], "left")
    else:
        px = px.withColumn("ratio", F.lit(1.0))
    prev = F.lag("price").over(Window.partitionBy(*keys).orderBy("dt"))
    grown = (F.col("price") + F.coalesce("div", F.lit(0.0))) / F.col("__prev") * F.coalesce("ratio", F.lit(1.0)) * (1.0 - drag)
    return px.withColumn("__prev", prev).select(
        *keys, "dt", "price", F.when(F.col("__prev").isNull(), 1.0).when(F.col("__prev") != 0, grown).alias("multiplier")
    )


def total_return(
    bars: DataFrame,
    dividends: DataFrame | None,
    *,
    keys: Sequence[str] = ("asset_id",),
    price: str = "closeunadj",
    drag: Column | float = 0.0,
    split_ratios: DataFrame | None = None,
) -> DataFrame:
    """Cumulative total return per key (1.0 on its first bar) and the daily return.

    A key has at most one bar per session, so its window is bounded by the calendar.
    """
    m = multipliers(bars, dividends, keys=keys, price=price, drag=drag, split_ratios=split_ratios)
    tr = running(m, keys=list(keys), order=["dt"], exprs={"__tr": ("product", "multiplier")})
    return tr.select(
        *keys, "dt", F.when(F.col("multiplier").isNotNull(), F.col("__tr")).alias("tr"),
        (F.col("multiplier") - 1.0).alias("daily_return"),
    )


def step_rate(dates: DataFrame, schedule: DataFrame, *, at: str = "dt") -> DataFrame:
    """Rate in force on each date (boundary day included), its daily drag and a status."""
    hit = asof_join(
        dates, schedule, by=[], left_ts=at, right_ts="effective_from", payload=["rate"],
        right_unique=True, block=None, matched="__covered",
    )
    return hit.select(
        *dates.columns, "rate", (F.col("rate") / TRADING_DAYS_PER_YEAR).alias("daily_drag"),
        F.when(F.col("__covered"), "ok").otherwise("before_schedule").alias("status"),
    )


def dq_schedule(schedule: DataFrame) -> DataFrame:
    """Schedule rows that repeat or share an effective date (an empty result is a valid schedule)."""
    return schedule.groupBy("effective_from").agg(F.count(F.lit(1)).alias("n")).filter(
        (F.col("n") > 1) | F.col("effective_from").isNull()
    )


def annualize_252(tr: DataFrame, *, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """(last/first)^(252/(n-1)) - 1 per key."""
    ends = tr.groupBy(*keys).agg(
        F.min_by("tr", "dt").alias("__first"), F.max_by("tr", "dt").alias("__last"), F.count(F.lit(1)).alias("n_days")
    )
    value = F.pow(F.col("__last") / F.col("__first"), F.lit(float(TRADING_DAYS_PER_YEAR)) / (F.col("n_days") - 1)) - 1.0
    return ends.select(
        *keys, "n_days", F.when(F.col("n_days") >= 2, value).alias("annualized_return"),
        F.when(F.col("n_days") >= 2, "ok").otherwise("too_short").alias("status"),
    )


def annualize_nominal(growth: Column, tag: Column, days: Column) -> Column:
    """1y is the period return; 3y/5y/10y take the N-th root; si uses 365.25-day years."""
    out = F.when(tag == "1y", growth - 1.0)
    for name, years in TAG_YEARS.items():
        if years > 1:
            out = out.when(tag == name, F.pow(growth, F.lit(1.0 / years)) - 1.0)
    return out.when((tag == "si") & (days > 0), F.pow(growth, F.lit(365.25) / days) - 1.0)


def pct_change(df: DataFrame, *, keys: Sequence[str], order: str, value: str, out: str = "ret", block=None) -> DataFrame:
    """Simple change against the previous row of the key (NULL on the first)."""
    lagged = running(df, keys=list(keys), order=[order], exprs={"__prev": ("lag", value)}, block=block)
    return lagged.withColumn(out, F.when(F.col("__prev") != 0, F.col(value) / F.col("__prev") - 1.0)).drop("__prev")


def period_returns(curves: DataFrame, dates: DataFrame, *, keys: Sequence[str] = ("curve_id",), order: str = "dt") -> DataFrame:
    """NAV sampled on the given dates, then the change between neighbouring samples."""
    sampled = curves.join(dates.select(order).distinct(), order, "left_semi")
    return pct_change(sampled, keys=keys, order=order, value="nav").filter(F.col("ret").isNotNull())


def rolling_market_state(
    bars: DataFrame,
    *,
    window: int = 20,
    keys: Sequence[str] = ("asset_id",),
    order: str = "dt",
    price: str = "closeunadj",
    exclude_current: bool = True,
    block: Column | None = None,
) -> DataFrame:
    """Rolling mean volume (v_d) and population volatility of returns (sigma_d).

    With `exclude_current` the frame ends on the bar before, so a value can be used
    on its own date without looking ahead.
    """
    with_ret = pct_change(bars, keys=keys, order=order, value=price, out="ret", block=block)
    if block is None:
        return rolling_moments(
            with_ret, keys=list(keys), order=[order], window=window, exclude_current=exclude_current,
            exprs={"v_d": ("avg", "volume"), "sigma_d": ("stddev_pop", "ret")},
        )
    return rolling(
        with_ret, keys=list(keys), order=[order], window=window, exclude_current=exclude_current, block=block,
        exprs={
            "v_d": (F.avg("volume"), F.col("volume")),
            "sigma_d": (F.stddev_pop("ret"), F.col("ret")),
        },
    )


def split_ratio_on_bars(bars: DataFrame, splits: DataFrame, *, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """(keys, dt, ratio): splits moved to the first bar on or after their ex-date."""
    keys = list(keys)
    daily = splits.groupBy(*keys, "ex_date").agg(F.product("ratio").alias("ratio"))
    moved = asof_join(
        daily, bars.select(*keys, "dt", F.col("dt").alias("bar_dt")), by=keys, left_ts="ex_date", right_ts="dt",
        payload=["bar_dt"], direction="forward", right_unique=True,
    )
    return moved.filter(F.col("bar_dt").isNotNull()).groupBy(*keys, F.col("bar_dt").alias("dt")).agg(
        F.product("ratio").alias("ratio")
    )


def split_factor(bars: DataFrame, splits: DataFrame, *, keys: Sequence[str] = ("asset_id",), perspective: str | None = None) -> DataFrame:
    """Bars with `factor`, the product of the ratios of all later splits.

    Dividing a price by it states the price on the latest share basis.  `perspective`
    (a date) ignores everything after that date.
    """
    keys = list(keys)
    if perspective is not None:
        day = F.lit(perspective).cast("date")
        bars, splits = bars.filter(F.col("dt") <= day), splits.filter(F.col("ex_date") <= day)
    ratios = split_ratio_on_bars(bars, splits, keys=keys)
    joined = bars.join(ratios, keys + ["dt"], "left")
    later = running(
        joined, keys=keys, order=["dt"], exprs={"__later": ("product", F.coalesce("ratio", F.lit(1.0)))},
        exclusive=True, descending=True,
    )
    return later.withColumn("factor", F.coalesce("__later", F.lit(1.0))).drop("__later", "ratio")


def adjust_dividends(dividends: DataFrame, factored_bars: DataFrame, *, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Dividends on the split basis of the nearest bar at or before the ex-date (1 if none)."""
    hit = asof_join(
        dividends, factored_bars, by=list(keys), left_ts="ex_date", right_ts="dt", payload=["factor"], right_unique=True
    )
    factor = F.coalesce("factor", F.lit(1.0))
    return hit.withColumn("factor", factor).withColumn("adjusted_amount", F.col("amount_per_share") / F.col("factor"))


def last_bar_on_or_before(targets: DataFrame, bars: DataFrame, *, keys: Sequence[str] = ("asset_id",), at: str = "target") -> DataFrame:
    """Greatest bar date <= target per key (NULL when there is none)."""
    right = bars.select(*keys, "dt", F.col("dt").alias("bar_dt"))
    return asof_join(targets, right, by=list(keys), left_ts=at, right_ts="dt", payload=["bar_dt"], right_unique=True)


def adjusted_close(
    bars: DataFrame, splits: DataFrame, *, keys: Sequence[str] = ("asset_id",), price: str = "closeunadj",
    perspective: str | None = None,
) -> DataFrame:
    """Close as seen from a later date; without a perspective the raw close."""
    if perspective is None:
        return bars.select(*keys, "dt", F.col(price).alias("adjusted_close"))
    out = split_factor(bars, splits, keys=keys, perspective=perspective)
    return out.select(*keys, "dt", (F.col(price) / F.col("factor")).alias("adjusted_close"))
