"""Typed scans of the vendor tables.

A bundle is a folder ``root/<bundle>/<table>.parquet`` (a file or a folder of part
files).  Vendor dates may be stored as dates or as timestamps.  Bounds on a
timestamp column are written as timestamp literals against the stored column, so
they reach the parquet reader; the column becomes a DATE only after that.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.sources import schemas

# As-reported dimensions; the restated ones are refused.
AS_REPORTED = ("ARQ", "ART", "ARY")
PRICE_FIELDS = ("open", "high", "low", "close", "volume")

Day = str | dt.date | None


def _literal_day(value: str | dt.date) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def day_bounds(df: DataFrame, column: str, start: Day = None, end: Day = None) -> DataFrame:
    """Inclusive day range on a DATE or timestamp column, without casting the column."""
    kind = df.schema[column].dataType
    stamped = not isinstance(kind, T.DateType)
    if start is not None:
        lo = F.lit(_literal_day(start))
        df = df.filter(F.col(column) >= (lo.cast(kind) if stamped else lo))
    if end is not None:
        hi = _literal_day(end)
        if stamped:
            df = df.filter(F.col(column) < F.lit(hi + dt.timedelta(days=1)).cast(kind))
        else:
            df = df.filter(F.col(column) <= F.lit(hi))
    return df


def scan_table(
    spark: SparkSession, root: str, table: str, *, bundle: str | None = None, filters: Sequence[Column] = (),
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Scan of one vendor table as stored (columns typed by the file, dates not yet cast).

    `rename` maps stored column names to declared ones.  It is a projection over the file scan, so
    filters on declared names, here or in later operators, reach the Parquet reader, and a `bundle`
    is read from its folder alone.
    """
    if table not in schemas.TABLES:
        raise KeyError(f"unknown table {table!r}; expected one of {sorted(schemas.TABLES)}")
    folder = f"{root}/{bundle}" if bundle else root
    path = f"{folder}/{table}.parquet"
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from None
        raise
    if rename:
        unknown = sorted(set(rename) - set(df.columns))
        if unknown:
            raise KeyError(f"{path} has no columns {unknown}")
        df = df.select(*[F.col(c).alias(rename.get(c, c)) for c in df.columns])
    for condition in filters:
        df = df.filter(condition)
    return df


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast the declared columns; wide tables keep their other columns."""
    declared = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.TABLES[table].fields if f.name in df.columns]
    if table not in schemas.WIDE_TABLES:
        return df.select(*declared)
    named = set(schemas.TABLES[table].fieldNames())
    return df.select(*declared, *[c for c in df.columns if c not in named])


def scan_prices(raw: DataFrame, *, ticker: str | None = None, start: Day = None, end: Day = None) -> DataFrame:
    df = raw if ticker is None else raw.filter(F.col("ticker") == ticker)
    df = day_bounds(df, "date", start, end)
    return conform(df, "sep").withColumnRenamed("date", "dt")


def scan_actions(
    raw: DataFrame, *, ticker: str | None = None, start: Day = None, end: Day = None, allow: Iterable[str] | None = None
) -> DataFrame:
    df = raw if ticker is None else raw.filter(F.col("ticker") == ticker)
    df = day_bounds(df, "date", start, end)
    if allow is not None:
        df = df.filter(F.col("action").isin(*sorted(allow)))
    return conform(df, "actions")


def scan_dividends(raw: DataFrame, *, ticker: str | None = None, start: Day = None, end: Day = None) -> DataFrame:
    df = scan_actions(raw, ticker=ticker, start=start, end=end, allow=["dividend"])
    return df.select("ticker", F.col("date").alias("ex_date"), F.col("value").alias("amount_per_share"))


def scan_tickers(
    raw: DataFrame, *, ticker: str | None = None, permaticker: int | None = None, active_at: Day = None
) -> DataFrame:
    df = raw
    if ticker is not None:
        df = df.filter(F.col("ticker") == ticker)
    if permaticker is not None:
        df = df.filter(F.col("permaticker") == permaticker)
    if active_at is not None:
        df = day_bounds(df, "firstpricedate", end=active_at)
        last = F.col("lastpricedate")
        df = df.filter(last.isNull() | (last >= F.lit(_literal_day(active_at)).cast(df.schema["lastpricedate"].dataType)))
    return conform(df, "tickers")


def as_reported(dimension: str) -> str:
    upper = dimension.upper()
    if upper not in AS_REPORTED:
        raise ValueError(f"dimension {dimension!r} is not as-reported; use one of {list(AS_REPORTED)}")
    return upper


def scan_fundamentals(
    raw: DataFrame, *, dimension: str = "ARQ", ticker: str | None = None, start: Day = None, end: Day = None
) -> DataFrame:
    """Rows of one as-reported dimension, filed in [start, end]; all measures pass through."""
    df = raw.filter(F.col("dimension") == as_reported(dimension))
    if ticker is not None:
        df = df.filter(F.col("ticker") == ticker)
    return conform(day_bounds(df, "datekey", start, end), "sf1")


def scan_membership(
    raw: DataFrame, *, ticker: str | None = None, action: str | None = None, start: Day = None, end: Day = None
) -> DataFrame:
    df = raw if ticker is None else raw.filter(F.col("ticker") == ticker)
    if action is not None:
        df = df.filter(F.col("action") == action)
    return conform(day_bounds(df, "date", start, end), "sp500")


def concat_batches(batches: Sequence[DataFrame], *, require_rows: bool = False) -> DataFrame:
    """Vertical union of batches with possibly different columns.

    `require_rows` fails when every batch is empty; it looks for one row (an action).
    """
    if not batches:
        raise ValueError("no batches to concatenate")
    out = batches[0]
    for nxt in batches[1:]:
        out = out.unionByName(nxt, allowMissingColumns=True)
    if require_rows and out.isEmpty():
        raise ValueError("every batch is empty")
    return out


def dedupe_identity(tickers: DataFrame, *, table: str = "SEP") -> DataFrame:
    """Identity rows of one vendor table (the source repeats them per table)."""
    return tickers.filter(F.col("table") == table)


def scan_reference_performance(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.PERFORMANCE).option("header", True).csv(path)
    return reference_performance(raw)


def scan_reference_distributions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DISTRIBUTIONS).option("header", True).csv(path)


def reference_performance(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lower-cased periods, percent to decimal, and a status that flags repeats."""
    low = raw.withColumn("period", F.lower("period"))
    repeats = low.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("__n"))
    return low.join(repeats, [*keys, "period"]).select(
        *keys, "period", (F.col("annualized_nav_tr_pct") / 100.0).alias("annualized_nav_tr"),
        F.when(F.col("__n") > 1, "duplicate").otherwise("ok").alias("status"),
    )


def reference_for(periods: DataFrame, performance: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Published figure per requested period; unknown periods get status `unknown_period`."""
    one = performance.groupBy(*keys, "period").agg(
        F.max("annualized_nav_tr").alias("annualized_nav_tr"), F.max("status").alias("__found"), F.count(F.lit(1)).alias("__n")
    )
    asked = periods.withColumn("period", F.lower("period"))
    status = F.when(F.col("__found").isNull(), "unknown_period").when(F.col("__n") > 1, "duplicate").otherwise("ok")
    return asked.join(one, [*keys, "period"], "left").select(
        *asked.columns, F.when(status == "ok", F.col("annualized_nav_tr")).alias("annualized_nav_tr"), status.alias("status")
    )


def profile_table(df: DataFrame, *, key: str = "ticker", day: str = "date") -> tuple[DataFrame, DataFrame]:
    """(per-key coverage, one-row whole-table coverage rolled up from it)."""
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
    )
    whole = per_key.agg(
        F.sum("n_rows").alias("n_rows"), F.count(key).alias("n_keys"),
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
    )
    return per_key, whole


def coverage_staleness(
    df: DataFrame, *, requested_end: Day, key: str = "ticker", day: str = "date", slack_days: int = 10
) -> DataFrame:
    """Keys whose newest row is more than `slack_days` before the requested end."""
    limit = F.date_sub(F.lit(_literal_day(requested_end)), slack_days)
    return df.groupBy(key).agg(F.max(day).alias("last_day")).filter(F.col("last_day") < limit)


def sentinel_staleness(
    df: DataFrame, sentinels: DataFrame, *, requested_end: Day, key: str = "ticker", day: str = "date", slack_days: int = 10
) -> DataFrame:
    """Status of each sentinel key: ok, stale, or absent (a warning, not a failure)."""
    limit = F.date_sub(F.lit(_literal_day(requested_end)), slack_days)
    newest = df.join(sentinels.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max(day).alias("last_day"))
    status = F.when(F.col("last_day").isNull(), "absent").when(F.col("last_day") < limit, "stale").otherwise("ok")
    return sentinels.select(key).distinct().join(newest, key, "left").select(key, "last_day", status.alias("status"))
