"""Index membership from periodic snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.identity import resolve_ticker, resolve_unique
from tempora.plans.asof import asof_join
from tempora.plans.status import enforce

SNAPSHOT_ACTIONS = ("historical", "current")
# Fixed value: the universe the vendor publishes snapshots for.
UNIVERSES = ("sp500",)


def check_universe(universe_id: str) -> str:
    if universe_id not in UNIVERSES:
        raise ValueError(f"unknown universe {universe_id!r}; accepted: {list(UNIVERSES)}")
    return universe_id


def membership_snapshots(log: DataFrame, securities: DataFrame, *, strict: bool = False) -> DataFrame:
    """Distinct (snapshot_date, ticker) resolved to assets; status marks unresolvable ones."""
    snaps = log.filter(F.col("action").isin(*SNAPSHOT_ACTIONS)).select(F.col("date").alias("snapshot_date"), "ticker").distinct()
    return enforce(resolve_unique(snaps, securities), strict=strict, context="membership_snapshots")


def _snapshot_of(dates: DataFrame, membership: DataFrame, at: str) -> DataFrame:
    """Each distinct date with the newest snapshot date at or before it."""
    snaps = membership.select("snapshot_date").distinct()
    asked = dates.select(at).distinct()
    # Distinct days on both sides: the scan without a key is bounded by the calendar.
    hit = asof_join(
        asked, snaps.select(F.col("snapshot_date").alias("__s"), "snapshot_date"), by=[], left_ts=at, right_ts="__s",
        payload=["snapshot_date"], right_unique=True,
    )
    return hit.filter(F.col("snapshot_date").isNotNull())


def members_at(dates: DataFrame, membership: DataFrame, *, at: str = "dt") -> DataFrame:
    """(date, asset) roster in force on each date; a date before the first snapshot has none."""
    rosters = membership.select("snapshot_date", "asset_id").distinct()
    return _snapshot_of(dates, membership, at).join(rosters, "snapshot_date").select(at, "snapshot_date", "asset_id")


def is_member(pairs: DataFrame, membership: DataFrame, *, at: str = "dt") -> DataFrame:
    """Adds `is_member` to (date, asset) pairs."""
    rosters = membership.select("snapshot_date", "asset_id").distinct().withColumn("__m", F.lit(True))
    with_snap = pairs.join(_snapshot_of(pairs, membership, at), at, "left")
    return with_snap.join(rosters, ["snapshot_date", "asset_id"], "left").select(
        *pairs.columns, F.coalesce("__m", F.lit(False)).alias("is_member")
    )


def membership_spells(membership: DataFrame) -> DataFrame:
    """Maximal runs over consecutive snapshots; NULL end when present in the latest.

    The end is the last snapshot that lists the asset, not the first that does not.
    An asset has at most one row per snapshot date, which bounds its window.
    """
    days = membership.select("snapshot_date").distinct()
    # One row per snapshot date: tiny by construction, so one global ordering is fine.
    numbered = days.withColumn("__pos", F.row_number().over(Window.orderBy("snapshot_date")))
    latest = membership.agg(F.max("snapshot_date")).scalar()
    rows = membership.select("snapshot_date", "asset_id").distinct().join(numbered, "snapshot_date")
    run = F.col("__pos") - F.row_number().over(Window.partitionBy("asset_id").orderBy("snapshot_date"))
    spells = rows.withColumn("__run", run).groupBy("asset_id", "__run").agg(
        F.min("snapshot_date").alias("spell_start"), F.max("snapshot_date").alias("__end")
    )
    return spells.select("asset_id", "spell_start", F.when(F.col("__end") != latest, F.col("__end")).alias("spell_end"))


def ever_members(dates: DataFrame, membership: DataFrame, *, at: str = "dt") -> DataFrame:
    """Assets on any roster in force on the given dates (only those snapshots are read)."""
    used = _snapshot_of(dates, membership, at).select("snapshot_date").distinct()
    return membership.join(used, "snapshot_date", "left_semi").select("asset_id").distinct()


def untradeable_members(dates: DataFrame, membership: DataFrame, securities: DataFrame, *, at: str = "dt") -> DataFrame:
    """Per date: roster size, members without an active listing, and their share."""
    roster = members_at(dates, membership, at=at).select(at, "asset_id")
    listed = resolve_ticker(roster, securities, at=at)
    missing = F.count(F.when(F.col("status") == "not_found", 1))
    return listed.groupBy(at).agg(F.count(F.lit(1)).alias("n_members"), missing.alias("n_untradeable")).withColumn(
        "share", F.col("n_untradeable") / F.col("n_members")
    )
