"""Fundamentals and prices as of a request date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators.identity import resolve_ticker
from tempora.plans.asof import asof_join
from tempora.plans.status import enforce
from tempora.sources.scan import PRICE_FIELDS, as_reported


def asof_facts(
    requests: DataFrame,
    facts: DataFrame,
    fields: Sequence[str],
    *,
    dimension: str = "ARQ",
    by: Sequence[str] = ("asset_id",),
    at: str = "dt",
    matched: str | None = None,
) -> DataFrame:
    """Fields of the newest filing with datekey <= the request date.

    Ties on datekey go to the later calendardate.  All fields come from that one row,
    and a NULL there stays NULL: older filings are never consulted.
    """
    missing = [f for f in fields if f not in facts.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}; available: {sorted(facts.columns)}")
    filed = facts.filter(F.col("dimension") == as_reported(dimension))
    return asof_join(
        requests, filed, by=list(by), left_ts=at, right_ts="datekey", payload=list(fields), tie_break=["calendardate"],
        matched=matched,
    )


def shares_outstanding(requests: DataFrame, facts: DataFrame, *, at: str = "dt") -> DataFrame:
    hit = asof_facts(requests, facts, ["sharesbas"], at=at)
    return hit.withColumn("source", F.when(F.col("sharesbas").isNotNull(), "sf1")).withColumn("estimated", F.lit(False))


def price_counts(bars: DataFrame, field: str, keys: Sequence[str]) -> DataFrame:
    """(keys, dt, n_rows, value): several rows on one date are counted, not hidden."""
    return bars.groupBy(*keys, "dt").agg(F.count(F.lit(1)).alias("__n"), F.max(field).alias("__value"))


def lookup_price(
    requests: DataFrame, bars: DataFrame, securities: DataFrame, field: str = "close", *, strict: bool = False
) -> DataFrame:
    """Exact (asset, date) value of one bar field, through the ticker active that day."""
    if field not in PRICE_FIELDS:
        raise ValueError(f"field must be one of {PRICE_FIELDS}, got {field!r}")
    named = resolve_ticker(requests, securities)
    hit = named.join(price_counts(bars, field, ["ticker"]), ["ticker", "dt"], "left")
    status = (
        F.when(F.col("status") != "ok", F.concat(F.lit("ticker_"), F.col("status")))
        .when(F.col("__value").isNull() & (F.coalesce("__n", F.lit(0)) <= 1), "not_found")
        .when(F.col("__n") > 1, "duplicate").otherwise("ok")
    )
    out = hit.withColumn("status", status).select(
        *requests.columns, F.when(F.col("status") == "ok", F.col("__value").cast("double")).alias(field), "status"
    )
    return enforce(out, strict=strict, context="lookup_price")


def market_cap(requests: DataFrame, facts: DataFrame, bars: DataFrame, *, at: str = "dt", by: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Reported market cap, else shares x raw close of the same filing row and day."""
    by = list(by)
    hit = asof_facts(requests, facts, ["marketcap", "sharesbas"], by=by, at=at)
    px = price_counts(bars, "closeunadj", by).withColumnRenamed("dt", at)
    joined = hit.join(px, by + [at], "left")
    estimate = F.when(F.col("__n") == 1, F.col("sharesbas") * F.col("__value"))
    reported = F.col("marketcap").isNotNull()
    usable = ~reported & estimate.isNotNull()
    duplicate = ~reported & F.col("sharesbas").isNotNull() & (F.coalesce("__n", F.lit(0)) > 1)
    return joined.select(
        *requests.columns,
        F.coalesce("marketcap", estimate).alias("market_cap"),
        F.when(reported, "sf1").when(usable, "sep_estimated").alias("source"),
        usable.alias("estimated"),
        F.when(duplicate, "duplicate").when(~reported & ~usable, "none").otherwise("ok").alias("status"),
    )
