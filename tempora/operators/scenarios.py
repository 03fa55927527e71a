"""Parameter grids: a scenario is one more key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.plans.ranks import attach
from tempora.session import materialise


def with_scenarios(df: DataFrame, param: str, values: Sequence[float]) -> DataFrame:
    """Every row once per parameter value, with `scenario_no` in grid order.

    The grid is a literal array, so no join is planned.  Repeat small tables (weights,
    rebalances) and not bars: the operators carry extra keys through.
    """
    if not values:
        raise ValueError("the parameter grid is empty")
    grid = F.posexplode(F.array(*[F.lit(float(x)) for x in values]))
    return df.select("*", grid.alias("scenario_no", param))


def sensitivity_band(
    summary: DataFrame, *, param: str, central: float, capital: float, keys: Sequence[str] = ()
) -> DataFrame:
    """Per value: final_pnl, difference to the central value in bps of capital, and the band."""
    keys = list(keys)
    # Read three times; without this the valuation behind it would run three times.
    summary = materialise(summary)
    middle = summary.filter(F.col(param) == F.lit(float(central))).groupBy(*keys).agg(F.max("final_pnl").alias("central_pnl"))
    bounds = summary.groupBy(*keys).agg(F.min("final_pnl").alias("min_pnl"), F.max("final_pnl").alias("max_pnl"))
    joined = attach(attach(summary, middle, keys), bounds, keys)
    delta = (F.col("final_pnl") - F.col("central_pnl")) / F.lit(float(capital)) * 10_000.0
    return joined.select(*keys, param, "final_pnl", delta.alias("delta_bps_vs_central"), "min_pnl", "max_pnl")


def dq_sensitivity(summary: DataFrame, *, param: str, central: float, same: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Problems of a sweep: central value missing, repeated values, or runs that differ in more."""
    agg = summary.groupBy(*keys).agg(
        F.max((F.col(param) == F.lit(float(central))).cast("int")).alias("__central"),
        F.count(F.lit(1)).alias("__n"), F.countDistinct(param).alias("__d"),
        *[F.count_distinct(F.col(c)).alias(f"__s_{c}") for c in same],
    )
    checks = [(F.col("__central") == 0, "central_missing"), (F.col("__n") != F.col("__d"), "value_repeated")]
    checks += [(F.col(f"__s_{c}") > 1, f"{c}_differs") for c in same]
    found = F.filter(F.array(*[F.when(c, F.lit(label)) for c, label in checks]), lambda x: x.isNotNull())
    return agg.select(*keys, F.explode(found).alias("problem"))
