"""Corporate actions and per-share cash flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.plans.intervals import interval_join
from tempora.session import materialise

# What each vendor action code means here.
DISPATCHED = {"dividend": "cash_dividend", "spinoff": "spinoff_cash_equivalent", "split": "split"}
SKIPPED = (
    "listed", "initiated", "delisted", "transfer", "tradinghaltresumed", "acquisitionbystock", "acquisitionbycash",
    "acquisitionunknown", "bankruptcyliquidation", "bankruptcyreorganization",
)
# Same-day order of cash flows.
FLOW_ORDER = {"cash_dividend": 0, "spinoff_cash_equivalent": 1, "delisting_cash_proceeds": 2}


def _kind(action):
    out = None
    for code, kind in DISPATCHED.items():
        out = F.when(action == code, kind) if out is None else out.when(action == code, kind)
    return out.when(action.isin(*SKIPPED), "skipped").otherwise("unknown")


def classify_actions(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dispatched rows with action_type, rows whose code nobody listed)."""
    kinded = actions.withColumn("action_type", _kind(F.col("action")))
    known = kinded.filter(F.col("action_type").isin(*DISPATCHED.values()))
    unknown = kinded.filter(F.col("action_type") == "unknown").drop("action_type")
    return known, unknown


def corporate_actions(ranges: DataFrame, actions: DataFrame, *, start: str = "start", end: str = "end") -> DataFrame:
    """Splits with an ex-date inside each requested range (both ends included)."""
    known, _ = classify_actions(actions)
    splits = known.filter(F.col("action_type") == "split").select(
        "asset_id", F.col("date").alias("ex_date"), F.col("value").alias("ratio")
    )
    return interval_join(splits, ranges, by=["asset_id"], at="ex_date", start=start, end=end)


def delisting_proceeds(securities: DataFrame, bars: DataFrame) -> DataFrame:
    """Raw close on the last trading day of each delisted asset, with a status.

    An asset with several listing rows is judged by its newest; an open end counts
    as newest.  A missing bar, a NULL price or two bars on that day are reported.
    """
    recency = F.struct(F.col("lastpricedate").isNull(), "lastpricedate", "ticker")
    last = securities.groupBy("permaticker").agg(F.max_by(F.struct("ticker", "isdelisted", "lastpricedate"), recency).alias("__l"))
    # Read twice: only the bars of these days are counted.
    gone = materialise(last.select("permaticker", "__l.*").filter((F.col("isdelisted") == "Y") & F.col("lastpricedate").isNotNull()))
    asked = bars.select("ticker", F.col("dt").alias("lastpricedate"), "closeunadj").join(gone, ["ticker", "lastpricedate"], "left_semi")
    px = asked.groupBy("ticker", "lastpricedate").agg(
        F.count(F.lit(1)).alias("__n"), F.max("closeunadj").alias("__px")
    )
    status = (
        F.when(F.col("__n").isNull(), "missing_bar").when(F.col("__n") > 1, "duplicate_bar")
        .when(F.col("__px").isNull(), "null_price").otherwise("ok")
    )
    hit = gone.join(px, ["ticker", "lastpricedate"], "left").withColumn("status", status)
    return hit.select(
        F.col("permaticker").alias("asset_id"), "ticker", F.col("lastpricedate").alias("dt"),
        F.when(F.col("status") == "ok", F.col("__px")).alias("amount"), "status",
    )


def cash_flow_rows(actions: DataFrame, securities: DataFrame, bars: DataFrame) -> DataFrame:
    """(asset_id, dt, flow_type, amount, flow_order) of every flow there is."""
    known, _ = classify_actions(actions)
    paid = known.filter(F.col("action_type") != "split").select(
        "asset_id", F.col("date").alias("dt"), F.col("action_type").alias("flow_type"), F.col("value").alias("amount")
    )
    gone = delisting_proceeds(securities, bars).filter(F.col("status") == "ok").select(
        "asset_id", "dt", F.lit("delisting_cash_proceeds").alias("flow_type"), "amount"
    )
    rank = F.create_map(*[x for k, v in FLOW_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return paid.unionByName(gone).withColumn("flow_order", rank[F.col("flow_type")])


def cash_flows(ranges: DataFrame, actions: DataFrame, securities: DataFrame, bars: DataFrame, *, start="start", end="end") -> DataFrame:
    """Flows inside each requested range; sort by (dt, flow_order) for the booking order."""
    flows = cash_flow_rows(actions, securities, bars)
    return interval_join(flows, ranges, by=["asset_id"], at="dt", start=start, end=end)
