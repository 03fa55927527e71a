"""Ticker and asset resolution over listing intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.plans.intervals import active_at
from tempora.plans.status import enforce

def _status():
    return F.when(F.col("n_active") == 0, "not_found").when(F.col("n_active") > 1, "ambiguous").otherwise("ok")


def _index(securities: DataFrame) -> DataFrame:
    """Resolver index: rows that ever started trading."""
    return securities.filter(F.col("firstpricedate").isNotNull()).select(
        F.col("permaticker").alias("asset_id"), "ticker", "firstpricedate", "lastpricedate"
    )


def resolve_asset(requests: DataFrame, securities: DataFrame, *, at: str = "dt", strict: bool = False) -> DataFrame:
    """(ticker, date) -> asset_id, with status ok / not_found / ambiguous."""
    hit = active_at(
        requests, _index(securities), by=["ticker"], at=at, start="firstpricedate", end="lastpricedate", ident="asset_id",
        out="asset_id",
    )
    out = hit.withColumn("status", _status()).drop("n_active")
    return enforce(out, strict=strict, context="resolve_asset")


def resolve_ticker(requests: DataFrame, securities: DataFrame, *, at: str = "dt", strict: bool = False) -> DataFrame:
    """(asset_id, date) -> ticker, with status ok / not_found / ambiguous."""
    index = _index(securities).withColumn("__row", F.xxhash64("ticker", "firstpricedate", "lastpricedate"))
    hit = active_at(
        requests, index, by=["asset_id"], at=at, start="firstpricedate", end="lastpricedate", ident="__row", out="__row"
    )
    names = index.select("asset_id", "__row", "ticker").dropDuplicates(["asset_id", "__row"])
    out = hit.join(names, ["asset_id", "__row"], "left").withColumn("status", _status())
    return enforce(out.select(*requests.columns, "ticker", "status"), strict=strict, context="resolve_ticker")


def unique_tickers(securities: DataFrame) -> DataFrame:
    """(ticker, n_assets, asset_id) over the whole history; asset_id only when unique."""
    return _index(securities).groupBy("ticker").agg(
        F.countDistinct("asset_id").alias("n_assets"), F.min("asset_id").alias("__id")
    ).select("ticker", "n_assets", F.when(F.col("n_assets") == 1, F.col("__id")).alias("asset_id"))


def resolve_unique(tickers: DataFrame, securities: DataFrame, *, strict: bool = False) -> DataFrame:
    """ticker -> asset_id regardless of date; status tells reused and unknown tickers."""
    status = F.when(F.col("n_assets").isNull(), "not_found").when(F.col("n_assets") > 1, "ambiguous").otherwise("ok")
    out = tickers.join(unique_tickers(securities), "ticker", "left").withColumn("status", status).drop("n_assets")
    return enforce(out, strict=strict, context="resolve_unique")


def known_assets(requests: DataFrame, securities: DataFrame, *, unknown: bool = False) -> DataFrame:
    """Requests whose asset is in the index (or, with `unknown`, those that are not)."""
    ids = _index(securities).select("asset_id").distinct()
    return requests.join(ids, "asset_id", "left_anti" if unknown else "left_semi")


def asset_ticker_map(assets: DataFrame, securities: DataFrame, *, strict: bool = False) -> DataFrame:
    """One ticker per wanted asset; status marks absent assets and repeated rows."""
    rows = securities.select(F.col("permaticker").alias("asset_id"), "ticker")
    wanted = assets.select("asset_id").distinct()
    per = rows.groupBy("asset_id").agg(F.count(F.lit(1)).alias("__n"), F.min("ticker").alias("__t"))
    status = F.when(F.col("__n").isNull(), "absent").when(F.col("__n") > 1, "duplicate").otherwise("ok")
    out = wanted.join(per, "asset_id", "left").withColumn("status", status)
    return enforce(
        out.select("asset_id", F.when(F.col("status") == "ok", F.col("__t")).alias("ticker"), "status"),
        strict=strict, context="asset_ticker_map",
    )
