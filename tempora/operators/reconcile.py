"""Trailing-window reconciliation against published figures, and drift attribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators.calendar import snap, trailing_windows
from tempora.operators.returns import TRADING_DAYS_PER_YEAR, annualize_nominal, dividends_per_day, multipliers, step_rate
from tempora.plans.asof import asof_join
from tempora.plans.running import running

# Accepted difference per window, in basis points.
TOLERANCE_BPS = {"1y": 25.0, "3y": 8.0, "5y": 7.0, "10y": 15.0, "si": 20.0}


def delta_bps(ours, published):
    return (ours - published) * 10_000.0


def reconcile(
    bars: DataFrame,
    dividends: DataFrame,
    reference: DataFrame,
    as_ofs: DataFrame,
    calendar: DataFrame,
    *,
    keys: Sequence[str] = ("asset_id",),
    tolerances: Mapping[str, float] = TOLERANCE_BPS,
    price: str = "closeunadj",
) -> DataFrame:
    """One row per (key, window tag) with verdict PASS / FAIL / SKIPPED.

    `as_ofs` holds keys, as_of and inception; `reference` holds keys, period and
    annualized_nav_tr.  Returns are gross: published prices are already net of fees.
    Every window is answered from one cumulative index per key.
    """
    keys = list(keys)
    windows = trailing_windows(as_ofs, list(tolerances), calendar)
    factors = multipliers(bars, dividends, keys=keys, price=price)
    index = running(
        factors, keys=keys, order=["dt"], exprs={"tr": ("product", "multiplier"), "n": ("count", F.lit(1))}
    ).select(*keys, "dt", "tr", "n")
    coverage = index.groupBy(*keys).agg(F.min("dt").alias("__min"), F.max("dt").alias("__max"))
    first = index.select(*keys, "dt", F.col("tr").alias("__tr0"), F.col("n").alias("__n0"))
    last = index.select(*keys, "dt", F.col("tr").alias("__tr1"), F.col("n").alias("__n1"))
    at_start = asof_join(
        windows, first, by=keys, left_ts="window_start", right_ts="dt", payload=["__tr0", "__n0"], direction="forward", right_unique=True
    )
    at_end = asof_join(
        at_start, last, by=keys, left_ts="window_end", right_ts="dt", payload=["__tr1", "__n1"], right_unique=True
    )
    published = reference.select(*keys, F.col("period").alias("tag"), F.col("annualized_nav_tr").alias("published"))
    joined = at_end.join(coverage, keys, "left").join(published, keys + ["tag"], "left")
    reason = (
        F.when(F.col("window_start").isNull() | F.col("window_end").isNull(), "calendar misses window")
        .when(F.col("__min").isNull(), "no rows")
        .when((F.col("__min") > F.col("window_start")) | (F.col("__max") < F.col("window_end")), "bars do not cover window")
        .when(F.col("published").isNull(), "no published figure")
    )
    days = F.datediff("window_end", "window_start")
    ours = F.when(F.col("skip_reason").isNull(), annualize_nominal(F.col("__tr1") / F.col("__tr0"), F.col("tag"), days))
    tolerance = F.create_map(*[x for t, b in tolerances.items() for x in (F.lit(t), F.lit(float(b)))])[F.col("tag")]
    out = joined.withColumn("skip_reason", reason).withColumn("engine_return", ours)
    out = out.withColumn("delta_bps", delta_bps(F.col("engine_return"), F.col("published")))
    verdict = F.when(F.col("engine_return").isNull(), "SKIPPED").when(F.abs("delta_bps") <= tolerance, "PASS").otherwise("FAIL")
    return out.select(
        *keys, "tag", "window_start", "window_end", "engine_return",
        F.when(F.col("engine_return").isNotNull(), F.col("published")).alias("published_return"),
        "delta_bps",
        F.when(F.col("engine_return").isNotNull(), F.col("__n1") - F.col("__n0") + 1).alias("n_trading_days"),
        verdict.alias("verdict"), "skip_reason",
    )


def verdict(windows: DataFrame, *, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """FAIL if any window fails, else PASS if any passes, else NEEDS_DATA."""
    agg = windows.groupBy(*keys).agg(
        F.bool_or(F.col("verdict") == "FAIL").alias("__f"), F.bool_or(F.col("verdict") == "PASS").alias("__p")
    )
    return agg.select(*keys, F.when(F.col("__f"), "FAIL").when(F.col("__p"), "PASS").otherwise("NEEDS_DATA").alias("overall_verdict"))


def diff_dividends(ours: DataFrame, theirs: DataFrame, *, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Full outer comparison on (key, ex-date); delta is NULL when one side is missing."""
    on = [*keys, "ex_date"]
    a = ours.select(*on, F.col("amount_per_share").alias("ours_amount"))
    b = theirs.select(*on, F.col("amount_per_share").alias("theirs_amount"))
    return a.join(b, on, "full_outer").withColumn("delta", F.col("ours_amount") - F.col("theirs_amount"))


def dividend_totals(diff: DataFrame, *, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    return diff.groupBy(*keys).agg(
        F.coalesce(F.sum("ours_amount"), F.lit(0.0)).alias("ours_total"),
        F.coalesce(F.sum("theirs_amount"), F.lit(0.0)).alias("theirs_total"),
    )


def drift_attribution(
    bars: DataFrame,
    dividends: DataFrame,
    schedule: DataFrame,
    windows: DataFrame,
    reference: DataFrame,
    calendar: DataFrame,
    *,
    keys: Sequence[str] = ("asset_id",),
    price: str = "closeunadj",
) -> DataFrame:
    """How each convention moves one window's return away from the published figure.

    `windows` has keys, window_start and window_end; `reference` has keys and
    annualized_nav_tr.  Variants: drag, gross, price_only, shifted (anchor one
    session earlier, with drag) and the two unannualised period returns.
    """
    keys = list(keys)
    rates = step_rate(bars.select("dt").distinct(), schedule).select("dt", "daily_drag")
    px = bars.select(*keys, "dt", F.col(price).alias("price"))
    paid = dividends_per_day(dividends, keys).withColumnRenamed("ex_date", "dt")
    rows = px.join(paid, keys + ["dt"], "left").join(rates, "dt", "left")
    prev = running(rows, keys=keys, order=["dt"], exprs={"__prev": ("lag", "price")})
    first = F.col("__prev").isNull()
    gross = (F.col("price") + F.coalesce("div", F.lit(0.0))) / F.col("__prev")
    factors = prev.select(
        *keys, "dt",
        F.when(first, 1.0).otherwise(gross).alias("m_gross"),
        F.when(first, 1.0).otherwise(gross * (1.0 - F.col("daily_drag"))).alias("m_drag"),
        F.when(first, 1.0).otherwise(F.col("price") / F.col("__prev")).alias("m_price"),
    )
    index = running(
        factors, keys=keys, order=["dt"],
        exprs={"gross": ("product", "m_gross"), "drag": ("product", "m_drag"), "price": ("product", "m_price"), "n": ("count", F.lit(1))},
    ).select(*keys, "dt", F.struct("gross", "drag", "price", "n").alias("at"))
    earlier = snap(windows, calendar, at="window_start", inclusive=False, out="shifted_start")
    state = earlier
    for edge, name, direction in (
        ("window_start", "s0", "forward"), ("shifted_start", "s1", "forward"), ("window_end", "e0", "backward")
    ):
        state = asof_join(
            state, index.withColumnRenamed("at", name), by=keys, left_ts=edge, right_ts="dt", payload=[name],
            direction=direction, right_unique=True,
        )

    def growth(kind: str, start: str):
        return F.col(f"e0.{kind}") / F.col(f"{start}.{kind}")

    def annual(kind: str, start: str):
        steps = F.col("e0.n") - F.col(f"{start}.n")
        return F.when(steps >= 1, F.pow(growth(kind, start), F.lit(float(TRADING_DAYS_PER_YEAR)) / steps) - 1.0)

    variants = [
        ("with_drag", annual("drag", "s0")), ("gross", annual("gross", "s0")), ("price_only", annual("price", "s0")),
        ("shifted_anchor", annual("drag", "s1")), ("period_return", growth("drag", "s0") - 1.0),
        ("shifted_period_return", growth("drag", "s1") - 1.0),
    ]
    laid = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("value")) for n, c in variants])).alias("v")
    out = state.join(reference.select(*keys, "annualized_nav_tr"), keys).select(*keys, "annualized_nav_tr", laid)
    return out.select(
        *keys, F.col("v.variant").alias("variant"), F.col("v.value").alias("value"),
        delta_bps(F.col("v.value"), F.col("annualized_nav_tr")).alias("delta_bps"),
    )
