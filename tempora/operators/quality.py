"""Data-quality contracts: each rule is a DataFrame of violations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.calendar import shift_sessions
from tempora.operators.identity import unique_tickers
from tempora.plans.asof import asof_join

# First fiscal day the datekey rule covers, and sessions the first-price rule waits.
DATEKEY_FROM = "1991-01-01"
FIRST_PRICE_SESSIONS = 5
SAMPLE_ROWS = 10


def dq_first_price(tickers: DataFrame, sep: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Listings without a bar from the first price date to the 5th session after it.

    Listings that start before the earliest bar are outside the price coverage.  The
    first bar at or after the start is found by one forward as-of scan.
    """
    sessions = calendar if calendar is not None else sep.select(F.col("date").alias("dt")).distinct()
    listed = tickers.filter(F.col("firstpricedate") >= sep.agg(F.min("date")).scalar())
    limited = shift_sessions(listed, sessions, FIRST_PRICE_SESSIONS, at="firstpricedate", out="__cutoff")
    days = sep.select("ticker", "date").distinct()
    hit = asof_join(
        limited, days.withColumn("__bar", F.col("date")), by=["ticker"], left_ts="firstpricedate", right_ts="date",
        payload=["__bar"], direction="forward", right_unique=True,
    )
    # Past the end of the calendar there is no 5th session, so any later bar counts.
    late = F.col("__bar").isNull() | F.coalesce(F.col("__bar") > F.col("__cutoff"), F.lit(False))
    return hit.filter(late).select("permaticker", "ticker", "firstpricedate", "lastpricedate").distinct()


def dq_bars_after_delisting(tickers: DataFrame, sep: DataFrame) -> DataFrame:
    """Bars of a delisted ticker after its last price date (joined on the ticker only)."""
    gone = tickers.filter((F.col("isdelisted") == "Y") & F.col("lastpricedate").isNotNull()).select(
        "permaticker", "ticker", "lastpricedate"
    )
    return gone.join(sep.select("ticker", F.col("date").alias("sep_date"), "closeunadj"), "ticker").filter(
        F.col("sep_date") > F.col("lastpricedate")
    ).select("permaticker", "ticker", "lastpricedate", "sep_date", "closeunadj")


def dq_null_datekey(sf1: DataFrame) -> DataFrame:
    return sf1.filter(
        (F.col("dimension") == "ARQ") & (F.col("calendardate") >= F.lit(DATEKEY_FROM).cast("date")) & F.col("datekey").isNull()
    ).select("ticker", "calendardate", "dimension")


def _repeats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def dq_duplicate_facts(sf1: DataFrame) -> DataFrame:
    return _repeats(sf1, ["ticker", "datekey", "dimension"])


def dq_members_resolve(sp500: DataFrame, tickers: DataFrame) -> DataFrame:
    """Snapshot tickers that do not map to exactly one asset over the whole history."""
    members = sp500.filter(F.col("action").isin("historical", "current")).select("ticker").distinct()
    return members.join(unique_tickers(tickers).select("ticker", "n_assets"), "ticker", "left").select(
        "ticker", F.coalesce("n_assets", F.lit(0)).cast("long").alias("n_assets")
    ).filter(F.col("n_assets") != 1)


def dq_duplicate_events(sp500: DataFrame) -> DataFrame:
    return _repeats(sp500, ["ticker", "date", "action"])


def dq_events_vs_snapshots(sp500: DataFrame, sep: DataFrame) -> DataFrame:
    """Add/remove events the next snapshot contradicts.

    The next snapshot is the first on or after the event; later events are skipped.
    An opposite event after this one and up to that snapshot excuses it: the nearest
    opposite event is enough to know, so it is an as-of scan and not a self-join.
    """
    lo, hi = sep.agg(F.min("date")).scalar(), sep.agg(F.max("date")).scalar()
    snaps = sp500.filter(F.col("action").isin("historical", "current"))
    listed = snaps.select("ticker", F.col("date").alias("__snap")).distinct().withColumn("__present", F.lit(True))
    snap_days = snaps.select(F.col("date").alias("__d"), F.col("date").alias("__snap")).distinct()
    events = (
        sp500.filter(F.col("action").isin("added", "removed"))
        .filter(F.col("date").between(lo, hi))
        .select("ticker", F.col("date").alias("event_date"), "action")
    )
    placed = asof_join(
        events, snap_days, by=[], left_ts="event_date", right_ts="__d", payload=["__snap"], direction="forward", right_unique=True
    ).filter(F.col("__snap").isNotNull())
    judged = placed.join(listed, ["ticker", "__snap"], "left").withColumn("__present", F.coalesce("__present", F.lit(False)))
    odd = judged.filter(F.col("__present") == (F.col("action") == "removed"))
    opposite = F.when(F.col("action") == "added", "removed").otherwise("added")
    others = events.select("ticker", opposite.alias("action"), F.col("event_date").alias("__e"), F.col("event_date").alias("__next")).distinct()
    excused = asof_join(
        odd, others, by=["ticker", "action"], left_ts="event_date", right_ts="__e", payload=["__next"],
        direction="forward", inclusive=False, right_unique=True,
    )
    text = F.when(F.col("action") == "removed", "removed but still in next snapshot").otherwise("added but absent from next snapshot")
    return excused.filter(F.col("__next").isNull() | (F.col("__next") > F.col("__snap"))).select(
        "ticker", "event_date", "action", text.alias("inconsistency")
    )


def dq_scale(df: DataFrame, value: str = "annualized_return") -> DataFrame:
    """Annualised values outside [-1, 1]: percent taken for decimal."""
    return df.filter(~F.col(value).between(-1.0, 1.0))


def dq_market_state(state: DataFrame) -> DataFrame:
    return state.filter((F.col("v_d") <= 0) | (F.col("theta") <= 0) | (F.col("sigma_d") < 0))


# Fixed value: the only tier that may show a Sharpe ratio without its corrections.
UNCORRECTED_TIER = "single_run_pre_specified"


def dq_confidence_tier(results: DataFrame) -> DataFrame:
    """A raw Sharpe without PSR and DSR, outside the one tier that allows it."""
    bare = F.col("sr_hat").isNotNull() & (F.col("psr").isNull() | F.col("dsr").isNull())
    return results.filter(bare & (F.coalesce("confidence_tier", F.lit("")) != UNCORRECTED_TIER))


def dq_numeric_series(series: DataFrame, *, keys: Sequence[str], value: str, window: int, allow_negative: bool = True) -> DataFrame:
    """Per key: values that are NULL or not finite, negatives where forbidden, too few rows."""
    if window < 1:
        raise ValueError(f"window must be >= 1, got {window}")
    v = F.col(value).cast("double")
    broken = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    counted = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(broken, 1)).alias("n_not_finite"),
        F.count(F.when(~broken & (v < 0) & F.lit(not allow_negative), 1)).alias("n_negative"),
    ).withColumn("window_too_long", F.col("n_rows") < window)
    return counted.filter((F.col("n_not_finite") > 0) | (F.col("n_negative") > 0) | F.col("window_too_long"))


@dataclass(frozen=True)
class Contract:
    name: str
    required: tuple[str, ...]
    violations: Callable[[Mapping[str, DataFrame]], DataFrame] = field(repr=False)


# Contract names.
DEFAULT_CONTRACTS = (
    Contract("tickers_first_price_within_five_days", ("tickers", "sep"), lambda t: dq_first_price(t["tickers"], t["sep"])),
    Contract("no_sep_bars_after_delisting", ("tickers", "sep"), lambda t: dq_bars_after_delisting(t["tickers"], t["sep"])),
    Contract("sf1_datekey_non_null_after_1990", ("sf1",), lambda t: dq_null_datekey(t["sf1"])),
    Contract("no_duplicate_ticker_datekey_in_sf1", ("sf1",), lambda t: dq_duplicate_facts(t["sf1"])),
    Contract("sp500_snapshot_members_resolve", ("sp500", "tickers"), lambda t: dq_members_resolve(t["sp500"], t["tickers"])),
    Contract("no_duplicate_sp500_events", ("sp500",), lambda t: dq_duplicate_events(t["sp500"])),
    Contract(
        "sp500_added_removed_consistent_with_snapshots", ("sp500", "sep"), lambda t: dq_events_vs_snapshots(t["sp500"], t["sep"])
    ),
)


def run_contracts(
    tables: Mapping[str, DataFrame], contracts: Sequence[Contract] = DEFAULT_CONTRACTS, *, sample: int = SAMPLE_ROWS
) -> tuple[DataFrame | None, DataFrame | None]:
    """(summary, samples) over every contract whose tables are present.

    summary: contract, n_violations (0 for a pass).  samples: up to `sample` rows per
    contract as JSON; the per-contract limit is applied inside every task before the
    shuffle.  (None, None) when no contract can run.
    """
    runnable = [c for c in contracts if set(c.required) <= set(tables)]
    if not runnable:
        return None, None
    found = None
    for c in runnable:
        rows = c.violations(tables)
        rows = rows.select(F.lit(c.name).alias("contract"), F.to_json(F.struct(*rows.columns)).alias("row_json"))
        found = rows if found is None else found.unionByName(rows)
    spark = found.sparkSession
    names = spark.createDataFrame([(c.name,) for c in runnable], "contract string")
    counts = found.groupBy("contract").agg(F.count(F.lit(1)).alias("n_violations"))
    summary = names.join(counts, "contract", "left").select("contract", F.coalesce("n_violations", F.lit(0)).alias("n_violations"))
    order = Window.partitionBy("contract").orderBy("row_json")
    samples = found.withColumn("sample_no", F.row_number().over(order)).filter(F.col("sample_no") <= sample)
    return summary, samples
