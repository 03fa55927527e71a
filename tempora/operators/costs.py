"""Fills, the permanent-impact register, and cost reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import costs as K
from tempora.plans.asof import asof_join
from tempora.plans.running import running
from tempora.plans.status import enforce


def with_prior_close(bars: DataFrame, *, keys: Sequence[str] = ("asset_id",), close: str = "closeunadj") -> DataFrame:
    """Bars plus the previous bar's close (NULL on the first)."""
    return running(bars, keys=list(keys), order=["dt"], exprs={"prior_close": ("lag", close)})


def price_fills(
    orders: DataFrame,
    bars: DataFrame,
    market_state: DataFrame,
    *,
    keys: Sequence[str] = ("asset_id",),
    close: str = "closeunadj",
    eta: Column | float = K.ETA,
    beta: Column | float = K.BETA,
    gamma: Column | float = K.GAMMA,
    commission_per_share: Column | float = 0.0,
    commission_bps: Column | float = 0.0,
    strict: bool = False,
) -> DataFrame:
    """Fill price, impact split and commission of every order, with a status.

    fill = arrival x (1 + sign x temporary); the permanent part is a per-share amount
    on the fill price.  A zero order fills at arrival for nothing.
    """
    keys = list(keys)
    px = with_prior_close(bars, keys=keys, close=close).select(
        *keys, "dt", F.col("open").alias("__o"), F.col(close).alias("__c"), F.col("prior_close").alias("__p")
    )
    joined = orders.join(px, keys + ["dt"], "left").join(market_state.select(*keys, "dt", "sigma_d", "v_d", "theta"), keys + ["dt"], "left")
    model = F.col("fill_model")
    zero = F.col("shares") == 0
    status = (
        F.when(F.col("__c").isNull(), "no_bar")
        .when(K.fill_status(model, F.col("__p")) != "ok", K.fill_status(model, F.col("__p")))
        .when(~zero & F.col("sigma_d").isNull(), "no_market_state")
        .when(~zero & ~F.coalesce(F.col("v_d") > 0, F.lit(False)), "bad_market_state")
        .otherwise("ok")
    )
    perm, temp = K.impact_bps(F.col("shares"), F.col("sigma_d"), F.col("v_d"), F.col("theta"), eta=eta, beta=beta, gamma=gamma)
    sign = F.signum("shares")
    ok = F.col("status") == "ok"
    out = (
        joined.withColumn("status", status)
        .withColumn("arrival", F.when(ok, K.arrival_price(model, F.col("__o"), F.col("__c"), F.col("__p"))))
        .withColumn("slippage_bps", F.when(ok, 0.0))
        .withColumn("temporary_impact_bps", F.when(ok, temp))
        .withColumn("permanent_impact_bps", F.when(ok, perm))
        .withColumn("fill_price", F.col("arrival") * (F.lit(1.0) + sign * F.col("temporary_impact_bps") / K.BPS))
        .withColumn("permanent_impact_per_share", sign * F.col("permanent_impact_bps") / K.BPS * F.col("fill_price"))
        .withColumn(
            "commission",
            K.per_share_commission(F.when(ok, F.col("shares")), commission_per_share)
            + K.notional_commission(F.col("shares") * F.col("fill_price"), commission_bps),
        )
    )
    out = out.select(
        *orders.columns, "arrival", "fill_price", "slippage_bps", "temporary_impact_bps", "permanent_impact_bps",
        "permanent_impact_per_share", "commission", "status",
    )
    return enforce(out, strict=strict, context="price_fills")


def dq_single_fill(orders: DataFrame, *, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """More than one (non-zero) order per asset and day."""
    return orders.filter(F.col("shares") != 0).groupBy(*keys, "dt").agg(F.count(F.lit(1)).alias("n_orders")).filter(F.col("n_orders") > 1)


def cumulative_impact(fills: DataFrame, *, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """(keys, dt, impact_before, impact_after): signed per-share impact around each day's fill.

    A fill sees only earlier fills; the mark of the same day includes it.
    """
    keys = list(keys)
    daily = fills.groupBy(*keys, "dt").agg(F.sum("permanent_impact_per_share").alias("__d"))
    after = running(daily, keys=keys, order=["dt"], exprs={"impact_after": ("sum", "__d")})
    return after.select(*keys, "dt", (F.col("impact_after") - F.col("__d")).alias("impact_before"), "impact_after")


def adjust_prices(bars: DataFrame, impact: DataFrame, *, keys: Sequence[str] = ("asset_id",), price: str = "closeunadj") -> DataFrame:
    """Bars with `adjusted_price` = raw price + impact registered up to that day."""
    right = impact.select(*keys, F.col("dt").alias("__d"), "impact_after")
    hit = asof_join(bars, right, by=list(keys), left_ts="dt", right_ts="__d", payload=["impact_after"], right_unique=True)
    return hit.withColumn("adjusted_price", F.col(price) + F.coalesce("impact_after", F.lit(0.0))).drop("impact_after")


def impact_feedback(
    fills: DataFrame, *, keys: Sequence[str] = ("asset_id",), arrival: str = "arrival"
) -> DataFrame:
    """Fills priced off impacted prices, when the orders themselves are given.

    With k = sign x perm x (1 + sign x temp) the register obeys
    c_n = c_(n-1) x (1 + k_n) + k_n x a_n, a linear recurrence, so
    c_n = K_n x sum_j (k_j a_j / K_j) with K the running product of (1 + k).
    """
    keys = list(keys)
    sign = F.signum("shares")
    temp, perm = F.col("temporary_impact_bps") / K.BPS, F.col("permanent_impact_bps") / K.BPS
    base = fills.withColumn("__k", sign * perm * (1.0 + sign * temp))
    scaled = running(base, keys=keys, order=["dt"], exprs={"__grow": ("product", 1.0 + F.col("__k"))})
    summed = running(scaled, keys=keys, order=["dt"], exprs={"__sum": ("sum", F.col("__k") * F.col(arrival) / F.col("__grow"))})
    after = summed.withColumn("impact_after", F.col("__grow") * F.col("__sum"))
    before = (F.col("impact_after") - F.col("__k") * F.col(arrival)) / (1.0 + F.col("__k"))
    out = after.withColumn("impact_before", before)
    return out.withColumn("fill_price", (F.col(arrival) + F.col("impact_before")) * (1.0 + sign * temp)).withColumn(
        "permanent_impact_per_share", F.col("impact_after") - F.col("impact_before")
    ).drop("__k", "__grow", "__sum")


def implementation_shortfall(fills: DataFrame, *, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Per key: summed slippage, temporary and permanent bps, commission, and their total bps."""
    return fills.filter(F.col("status") == "ok").groupBy(*keys).agg(
        F.sum("slippage_bps").alias("slippage_bps"),
        F.sum("temporary_impact_bps").alias("temporary_impact_bps"),
        F.sum("permanent_impact_bps").alias("permanent_impact_bps"),
        F.sum("commission").alias("commission"),
        F.sum(K.total_bps(F.col("slippage_bps"), F.col("temporary_impact_bps"), F.col("permanent_impact_bps"))).alias("total_bps"),
    )


def estimate_vs_fill(fills: DataFrame, bars: DataFrame, *, keys: Sequence[str] = ("asset_id",), close: str = "closeunadj") -> DataFrame:
    """Pre-trade estimate against realised bps, with the drift-dependent tolerance.

    `fills` carries estimate_bps.  mid = (open + close)/2 is compared with the prior
    close (the open on a first bar); tolerance = 0.5 + 0.1 x |drift in bps|.
    """
    keys = list(keys)
    px = with_prior_close(bars, keys=keys, close=close)
    ref = F.coalesce("prior_close", "open")
    drift = F.when(ref != 0, ((F.col("open") + F.col(close)) / 2 - ref) / ref * K.BPS)
    mids = px.select(*keys, "dt", drift.alias("mid_drift_bps"))
    realised = K.total_bps(F.col("slippage_bps"), F.col("temporary_impact_bps"), F.col("permanent_impact_bps"))
    out = fills.filter(F.col("status") == "ok").join(mids, keys + ["dt"]).withColumn("fill_bps", realised)
    out = out.withColumn("tolerance_bps", 0.5 + 0.1 * F.abs("mid_drift_bps"))
    return out.select(
        *keys, "dt", "estimate_bps", "fill_bps", "mid_drift_bps", "tolerance_bps",
        (F.abs(F.col("estimate_bps") - F.col("fill_bps")) <= F.col("tolerance_bps")).alias("within"),
    )
