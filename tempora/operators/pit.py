"""Point-in-time visibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.plans.asof import asof_join
from tempora.plans.intervals import interval_join
from tempora.plans.running import auto_block, running


def visible_at(df: DataFrame, asof: str, *, available: str = "available_dt", inclusive: bool = False) -> DataFrame:
    """Rows visible on one date: strictly before it, or up to it when inclusive."""
    day = F.lit(asof).cast(df.schema[available].dataType)
    return df.filter(F.col(available) <= day if inclusive else F.col(available) < day)


def pit_slice(
    df: DataFrame,
    asofs: DataFrame,
    *,
    by: Sequence[str],
    available: str = "available_dt",
    asof: str = "asof",
    lookback: int,
    inclusive: bool = False,
) -> DataFrame:
    """Rows each (key, as-of date) may see, at most `lookback` days old.

    A slice without a lookback repeats the whole history for every date; the bounded
    form is a binned interval join whose output is exactly the visible rows.
    """
    day = F.col(asof)
    windows = asofs.select(
        *by, asof, F.date_sub(day, lookback).alias("__from"), (day if inclusive else F.date_sub(day, 1)).alias("__to")
    )
    out = interval_join(df, windows, by=by, at=available, start="__from", end="__to", bin_days=max(16, lookback))
    return out.drop("__from", "__to")


def visible_totals(
    df: DataFrame, asofs: DataFrame, *, by: Sequence[str], sums: Sequence[str], available: str = "available_dt", asof: str = "asof",
    inclusive: bool = False,
) -> DataFrame:
    """Count, first and last date and sums of all rows each (key, as-of date) may see, however old.

    Totals of every key and date are added up along the key once, and looked up.
    """
    keys = list(by)
    daily = df.groupBy(*keys, F.col(available).alias("__day")).agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(c).alias(c) for c in sums])
    upto = running(
        daily, keys=keys, order=["__day"], block=auto_block(daily, "__day"),
        exprs={"__n": ("sum", "__rows"), "first_visible": ("min", F.col("__day")), **{f"sum_{c}": ("sum", c) for c in sums}},
    )
    upto = upto.select(*keys, "__day", F.col("__n").alias("n_visible"), "first_visible", F.col("__day").alias("last_visible"), *[f"sum_{c}" for c in sums])
    payload = ["n_visible", "first_visible", "last_visible", *[f"sum_{c}" for c in sums]]
    out = asof_join(asofs, upto, by=keys, left_ts=asof, right_ts="__day", payload=payload, inclusive=inclusive, right_unique=True)
    return out.withColumn("n_visible", F.coalesce("n_visible", F.lit(0).cast("long")))


def lookahead_violations(df: DataFrame, *, available: str, asof: str, context: str, period_end: str | None = None) -> DataFrame:
    """Rows read before they were observable (equal dates are allowed), with a message."""
    parts = [F.lit(f"lookahead leak in {context}: available="), F.col(available).cast("string"), F.lit(" > asof="), F.col(asof).cast("string")]
    if period_end is not None:
        parts += [F.lit(" period_end="), F.coalesce(F.col(period_end).cast("string"), F.lit("?"))]
    return df.filter(F.col(available) > F.col(asof)).withColumn("message", F.concat(*parts))
