"""Buy-and-hold of a past roster against today's roster over the same window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators.identity import resolve_ticker
from tempora.operators.membership import members_at
from tempora.operators.returns import multipliers
from tempora.plans.asof import asof_join
from tempora.plans.running import running


def cohort_returns(
    membership: DataFrame, securities: DataFrame, bars: DataFrame, dividends: DataFrame, windows: DataFrame
) -> DataFrame:
    """(pit_date, as_of, cohort, asset_id, terminal_tr): NULL when skipped.

    `windows` has pit_date and as_of.  A name is skipped when its ticker does not
    resolve at the pit date or it has fewer than two bars in the window.  A name that
    stops trading keeps the value of its last bar.
    """
    rosters = windows.select(
        "pit_date", "as_of",
        F.explode(
            F.array(
                F.struct(F.lit("pit").alias("cohort"), F.col("pit_date").alias("roster_dt")),
                F.struct(F.lit("current").alias("cohort"), F.col("as_of").alias("roster_dt")),
            )
        ).alias("c"),
    ).select("pit_date", "as_of", "c.*")
    members = rosters.join(members_at(rosters, membership, at="roster_dt").drop("snapshot_date"), "roster_dt").drop("roster_dt")
    listed = resolve_ticker(members.select("asset_id", "pit_date").distinct(), securities, at="pit_date")
    named = members.join(listed.select("asset_id", "pit_date", F.col("status").alias("__s")), ["asset_id", "pit_date"])
    held = named.filter(F.col("__s") == "ok").select("asset_id", "pit_date", "as_of").distinct()
    # One growth index per asset; a window is the index at its last bar over that at its first.
    factors = multipliers(bars, dividends, keys=["asset_id"])
    index = running(factors, keys=["asset_id"], order=["dt"], exprs={"__i": ("product", "multiplier"), "__k": ("count", F.lit(1))})
    ends = {}
    for side in ("first", "last"):
        ends[side] = index.select("asset_id", F.col("dt").alias("__dt"), F.col("__i").alias(f"__i_{side}"), F.col("__k").alias(f"__k_{side}"))
    grown = asof_join(held, ends["first"], by=["asset_id"], left_ts="pit_date", right_ts="__dt", payload=["__i_first", "__k_first"], direction="forward", right_unique=True)
    grown = asof_join(grown, ends["last"], by=["asset_id"], left_ts="as_of", right_ts="__dt", payload=["__i_last", "__k_last"], right_unique=True)
    grown = grown.select("asset_id", "pit_date", "as_of", F.try_divide("__i_last", "__i_first").alias("__growth"), (F.col("__k_last") - F.col("__k_first") + 1).alias("__n"))
    return named.join(grown, ["asset_id", "pit_date", "as_of"], "left").select(
        "pit_date", "as_of", "cohort", "asset_id",
        F.when((F.col("__s") == "ok") & (F.col("__n") >= 2), F.col("__growth")).alias("terminal_tr"),
    )


def survivorship(cohorts: DataFrame) -> DataFrame:
    """One row per window: cohort sizes, mean growth, CAGR of each and their difference."""
    per_asset = cohorts.groupBy("pit_date", "as_of", "asset_id").agg(
        F.max((F.col("cohort") == "pit").cast("int")).alias("in_pit"),
        F.max((F.col("cohort") == "current").cast("int")).alias("in_now"),
        F.max("terminal_tr").alias("tr"),
    )
    pit, now = F.col("in_pit") == 1, F.col("in_now") == 1
    sums = per_asset.groupBy("pit_date", "as_of").agg(
        F.sum("in_pit").alias("pit_count"), F.sum("in_now").alias("current_count"),
        F.count(F.when(pit & now, 1)).alias("survivor_count"),
        F.count(F.when(pit & ~now, 1)).alias("leaver_count"),
        F.count(F.when(pit, F.col("tr"))).alias("pit_priced"), F.count(F.when(now, F.col("tr"))).alias("current_priced"),
        F.coalesce(F.avg(F.when(pit, F.col("tr"))), F.lit(0.0)).alias("pit_mean_tr"),
        F.coalesce(F.avg(F.when(now, F.col("tr"))), F.lit(0.0)).alias("current_mean_tr"),
    )
    years = F.datediff("as_of", "pit_date") / 365.25

    def cagr(mean):
        return F.when(mean <= 0, -1.0).when(years <= 0, 0.0).otherwise(F.pow(mean, 1.0 / years) - 1.0)

    out = sums.withColumn("years", years).withColumn("pit_cagr", cagr(F.col("pit_mean_tr")))
    out = out.withColumn("current_cagr", cagr(F.col("current_mean_tr")))
    return out.withColumn("cagr_delta_bps", (F.col("current_cagr") - F.col("pit_cagr")) * 10_000.0)


def survivorship_lists(cohorts: DataFrame) -> DataFrame:
    """(window, asset, list): names skipped from the current cohort, and names that left."""
    per_asset = cohorts.groupBy("pit_date", "as_of", "asset_id").agg(
        F.max((F.col("cohort") == "pit").cast("int")).alias("in_pit"),
        F.max((F.col("cohort") == "current").cast("int")).alias("in_now"),
        F.max("terminal_tr").alias("tr"),
    )
    skipped = per_asset.filter((F.col("in_now") == 1) & F.col("tr").isNull()).withColumn("list", F.lit("skipped_current"))
    left = per_asset.filter((F.col("in_pit") == 1) & (F.col("in_now") == 0)).withColumn("list", F.lit("left_index"))
    return skipped.unionByName(left).select("pit_date", "as_of", "asset_id", "list")
