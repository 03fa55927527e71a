"""Cross-sectional momentum without recomputing windows.

The split-adjusted growth of a bar needs only the bar before it, so one cumulative
index per asset answers every rebalance date: score = index(near) / index(far) - 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators.identity import resolve_ticker
from tempora.operators.membership import members_at
from tempora.operators.returns import multipliers, split_ratio_on_bars
from tempora.plans.asof import asof_join
from tempora.plans.running import running

# Fixed value: bars a 12-1 signal declares it needs.
LOOKBACK_BARS = 273


def momentum_index(
    bars: DataFrame, dividends: DataFrame, splits: DataFrame, *, keys: Sequence[str] = ("asset_id",), price: str = "closeunadj"
) -> DataFrame:
    """(keys, dt, level, n_bad, bad): cumulative growth and running count of unusable closes."""
    keys = list(keys)
    ratios = split_ratio_on_bars(bars, splits, keys=keys)
    m = multipliers(bars, dividends, keys=keys, price=price, split_ratios=ratios)
    usable = m.withColumn("bad", F.when(F.col("price") <= 0, 1).otherwise(0)).withColumn(
        "__m", F.when(F.col("multiplier") > 0, F.col("multiplier")).otherwise(1.0)
    )
    return running(
        usable, keys=keys, order=["dt"], exprs={"level": ("product", "__m"), "n_bad": ("sum", "bad")}
    ).select(*keys, "dt", "level", "n_bad", "bad")


def momentum_scores(
    requests: DataFrame,
    index: DataFrame,
    *,
    keys: Sequence[str] = ("asset_id",),
    at: str = "dt",
    far_months: int = 12,
    near_months: int = 1,
) -> DataFrame:
    """Scores of (key, date) requests; requests without a usable window are omitted."""
    keys = list(keys)
    edges = requests.select(*keys, at).distinct().withColumn(
        "edge",
        F.explode(
            F.array(
                F.struct(F.lit("far").alias("side"), F.add_months(at, -far_months).alias("target")),
                F.struct(F.lit("near").alias("side"), F.add_months(at, -near_months).alias("target")),
            )
        ),
    ).select(*keys, at, "edge.*")
    bars = index.withColumn("point", F.struct(F.col("dt").alias("bar_dt"), "level", "n_bad", "bad")).select(*keys, "dt", "point")
    bars = bars.withColumnRenamed("dt", "__bar")
    hit = asof_join(edges, bars, by=keys, left_ts="target", right_ts="__bar", payload=["point"], right_unique=True)
    both = hit.groupBy(*keys, at).agg(
        F.max(F.when(F.col("side") == "far", F.col("point"))).alias("far"),
        F.max(F.when(F.col("side") == "near", F.col("point"))).alias("near"),
    )
    clean = (F.col("near.n_bad") - F.col("far.n_bad") + F.col("far.bad")) == 0
    return both.filter((F.col("far.bar_dt") < F.col("near.bar_dt")) & clean).select(
        *keys, at, (F.col("near.level") / F.col("far.level") - 1.0).alias("score")
    )


def momentum(
    rebalances: DataFrame,
    membership: DataFrame,
    securities: DataFrame,
    bars: DataFrame,
    dividends: DataFrame,
    splits: DataFrame,
    *,
    at: str = "dt",
    far_months: int = 12,
    near_months: int = 1,
) -> DataFrame:
    """(date, asset, score) for every rebalance date and every listed member on it."""
    roster = members_at(rebalances, membership, at=at).select("asset_id", at)
    listed = resolve_ticker(roster, securities, at=at).filter(F.col("status") == "ok")
    index = momentum_index(bars, dividends, splits)
    return momentum_scores(listed, index, at=at, far_months=far_months, near_months=near_months)


def lookback_guard(
    requests: DataFrame, bars: DataFrame, *, n: int = LOOKBACK_BARS, keys: Sequence[str] = ("asset_id",), at: str = "dt"
) -> DataFrame:
    """Requests with fewer than n bars strictly before their date, and how many there are."""
    keys = list(keys)
    counted = running(bars.select(*keys, "dt"), keys=keys, order=["dt"], exprs={"n_prior": ("count", F.lit(1))})
    counted = counted.withColumnRenamed("dt", "__bar")
    hit = asof_join(requests, counted, by=keys, left_ts=at, right_ts="__bar", payload=["n_prior"], inclusive=False, right_unique=True)
    return hit.withColumn("n_prior", F.coalesce("n_prior", F.lit(0))).filter(F.col("n_prior") < n)
