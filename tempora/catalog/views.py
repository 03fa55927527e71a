"""The driver tables presented in the shapes the operators work on.

Sums that feed prices are taken over whole cents, so the inputs do not depend on
the order in which partial sums meet.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora import session
from tempora.sources import scan


def _day(column) -> F.Column:
    return F.datediff(column, F.lit("1970-01-01").cast("date"))


def _cents(name: str):
    """Hundredths, halves away from zero as in `round`, which would go through a decimal of every value."""
    x = F.col(name) * 100
    whole = x.cast("long")
    return whole + F.when(x - whole >= 0.5, 1).when(x - whole <= -0.5, -1).otherwise(0)


def ticker(asset):
    """One ticker per asset, but of every hundred assets the last ten reuse those of the first ten."""
    return F.concat(F.lit("T"), (F.floor(asset / 100) * 90 + asset % 100 % 90).cast("string"))


VENDOR_BUNDLE = "daily_2024-01-01"
#: How the files of the bundle name some of the declared columns.
VENDOR_NAMES = {
    "sep": {"symbol": "ticker", "day": "date"}, "actions": {"kind": "action", "amount": "value"}, "tickers": {"symbol": "ticker", "first": "firstpricedate"},
    "sf1": {"symbol": "ticker", "filed": "datekey"}, "sp500": {"day": "date", "change": "action"},
}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.folders: list[str] = []
        self.written: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """`df`, worked out once and written."""
        out = session.materialise(df)
        self.folders.append(session.WRITTEN[-1])
        return out

    def folder(self, name: str) -> str:
        """A new shared folder that `discard` deletes."""
        path = session.scratch(self.spark, name)
        self.folders.append(path)
        return path

    @cached_property
    def vendor_root(self) -> str:
        return self.folder("vendor")

    def vendor(self, table: str, filters=()) -> DataFrame:
        """Scan of one table of a vendor bundle, whose files hold the views under the vendor's own column names and day types."""
        if table not in self.written:
            stored = {v: k for k, v in VENDOR_NAMES[table].items()}
            df = {
                "sep": lambda: self.bars.drop("asset_id").withColumn("dt", F.col("dt").cast("timestamp")).withColumnRenamed("dt", "date"),
                "actions": lambda: self.actions.drop("asset_id"), "tickers": lambda: self.securities,
                "sf1": lambda: self.filings.drop("asset_id"), "sp500": lambda: self.membership_log.drop("asset_id"),
            }[table]()
            df.withColumnsRenamed(stored).write.parquet(f"{self.vendor_root}/{VENDOR_BUNDLE}/{table}.parquet")
            self.written.add(table)
        return scan.scan_table(self.spark, self.vendor_root, table, bundle=VENDOR_BUNDLE, rename=VENDOR_NAMES[table], filters=filters)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def daily(self) -> DataFrame:
        """lineitem per (asset, day); the only aggregation of the big table, done once for all that read it."""
        return self.keep(
            self.table("lineitem")
            .groupBy(F.col("l_suppkey").alias("asset_id"), F.to_date("l_shipdate").alias("dt"))
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.sum(_cents("l_discount")).alias("disc"),
                F.sum(_cents("l_tax")).alias("tax"),
                F.max(_cents("l_tax")).alias("max_tax"),
                F.sum(F.col("l_quantity").cast("long")).alias("volume"),
                F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(-1) * F.col("l_quantity").cast("long")).alias("net"),
                F.max(F.col("l_returnflag") == "R").alias("has_r"),
            )
            # Scans by asset and day then merge sorted pieces instead of sorting their input anew.
            .sortWithinPartitions("asset_id", "dt")
        )

    @cached_property
    def bars(self) -> DataFrame:
        close = F.round(F.lit(50.0) + F.lit(5.0) * F.col("disc") / F.col("n") + F.lit(2.5) * F.col("tax") / F.col("n"), 6)
        return self.daily.withColumn("close", close).select(
            "asset_id",
            ticker(F.col("asset_id")).alias("ticker"),
            "dt",
            (F.col("close") * (F.lit(1.0) + F.lit(0.001) * (F.col("n") - 1))).alias("open"),
            (F.col("close") * F.lit(1.01)).alias("high"),
            (F.col("close") * F.lit(0.99)).alias("low"),
            "close",
            (F.col("close") + F.lit(1.0)).alias("closeunadj"),
            "volume",
        )

    @cached_property
    def calendar(self) -> DataFrame:
        return self.keep(self.daily.select("dt").distinct())

    @cached_property
    def dividends(self) -> DataFrame:
        return self.daily.filter(F.col("has_r") & (F.col("n") >= 2)).select(
            "asset_id",
            ticker(F.col("asset_id")).alias("ticker"),
            F.col("dt").alias("ex_date"),
            F.round(F.lit(0.01) + F.lit(0.005) * F.col("max_tax"), 6).alias("amount_per_share"),
        )

    @cached_property
    def actions(self) -> DataFrame:
        """Dividends, splits, spin-offs, announcements and one code nobody listed."""
        marks = self.daily.select("asset_id", "dt", _day(F.col("dt")).alias("day"))
        a, day = F.col("asset_id"), F.col("day")
        other = marks.select(
            "asset_id",
            "dt",
            F.explode(
                F.filter(
                    F.array(
                        F.struct(
                            F.lit("split").alias("action"),
                            F.when(a % 2 == 1, F.lit(0.5)).otherwise(F.lit(2.0)).alias("value"),
                            ((a * 31 + day) % 173 == 0).alias("on"),
                        ),
                        F.struct(
                            F.lit("spinoff").alias("action"), F.lit(0.25).alias("value"), ((a * 17 + day) % 211 == 0).alias("on")
                        ),
                        F.struct(F.lit("listed").alias("action"), F.lit(0.0).alias("value"), (day % 307 == 0).alias("on")),
                        F.struct(
                            F.lit("rightsissue").alias("action"),
                            F.lit(1.5).alias("value"),
                            ((a % 10 == 0) & (day % 97 == 0)).alias("on"),
                        ),
                    ),
                    lambda e: e["on"],
                )
            ).alias("e"),
        )
        other = other.select(
            "asset_id",
            ticker(F.col("asset_id")).alias("ticker"),
            F.col("dt").alias("date"),
            F.col("e.action").alias("action"),
            F.col("e.value").alias("value"),
        )
        paid = self.dividends.select(
            "asset_id", "ticker", F.col("ex_date").alias("date"), F.lit("dividend").alias("action"),
            F.col("amount_per_share").alias("value"),
        )
        return other.unionByName(paid)

    @cached_property
    def securities(self) -> DataFrame:
        """One interval per asset; tickers repeat, some starts and ends are NULL."""
        a = F.col("asset_id")
        late = F.lit("1999-01-01").cast("date")
        span = self.daily.groupBy("asset_id").agg(F.min("dt").alias("lo"), F.max("dt").alias("hi"))
        return span.select(
            a.alias("permaticker"),
            ticker(a).alias("ticker"),
            F.when(a % 5 == 0, "Y").otherwise("N").alias("isdelisted"),
            F.when(a % 37 == 36, F.lit(None).cast("date"))
            .when((a % 100 >= 90) & (a % 2 == 1), late)
            .otherwise(F.col("lo"))
            .alias("firstpricedate"),
            F.when((a % 100 < 10) & (a % 2 == 1), F.date_sub(late, 1))
            .when(a % 5 == 0, F.col("hi"))
            .otherwise(F.lit(None).cast("date"))
            .alias("lastpricedate"),
        )

    @cached_property
    def filings(self) -> DataFrame:
        o = self.table("orders").withColumn("d", F.to_date("o_orderdate"))
        pr = F.substring("o_orderpriority", 1, 1)
        asset = F.col("o_custkey") % self.table("lineitem").agg(F.max("l_suppkey") + 1).scalar()
        key = F.col("o_orderkey")
        return o.select(
            asset.alias("asset_id"),
            ticker(asset).alias("ticker"),
            F.when(pr.isin("1", "2"), "ARQ").when(pr == "3", "ART").when(pr == "4", "ARY").otherwise("MRQ").alias("dimension"),
            F.last_day("d").alias("calendardate"),
            F.when(key % 50 == 0, F.lit(None).cast("date")).otherwise(F.date_add("d", 45)).alias("datekey"),
            F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("double")).otherwise(F.col("o_totalprice")).alias("revenue"),
            F.when(key % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice") * F.lit(10.0)).alias("marketcap"),
            F.when(key % 7 == 0, F.lit(None).cast("double")).otherwise((F.col("o_custkey") + 1).cast("double")).alias("sharesbas"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        """Filings with one row per (asset, dimension, datekey, calendardate)."""
        return self.filings.groupBy("asset_id", "dimension", "datekey", "calendardate").agg(
            F.max("revenue").alias("revenue"), F.max("marketcap").alias("marketcap"), F.max("sharesbas").alias("sharesbas")
        )

    @cached_property
    def rosters(self) -> DataFrame:
        """(q, snapshot_date, asset_id): the half of each quarter's assets with the larger volumes."""
        q = F.year("dt") * 4 + F.quarter("dt")
        ends = self.calendar.groupBy(q.alias("q")).agg(F.max("dt").alias("snapshot_date"))
        traded = self.daily.groupBy(q.alias("q"), "asset_id").agg(F.sum("volume").alias("v"))
        top = Window.partitionBy("q").orderBy(F.col("v").desc(), F.col("asset_id"))
        all_of = F.count(F.lit(1)).over(Window.partitionBy("q"))
        kept = traded.select("q", "asset_id", F.row_number().over(top).alias("r"), all_of.alias("n")).filter(2 * F.col("r") <= F.col("n") + 1).drop("r", "n")
        return self.keep(kept.join(ends, "q").select("q", "snapshot_date", "asset_id"))

    @cached_property
    def membership(self) -> DataFrame:
        return self.rosters.select("snapshot_date", "asset_id")

    @cached_property
    def membership_log(self) -> DataFrame:
        r = self.rosters
        last_q, first_q = r.agg(F.max("q")).scalar(), r.agg(F.min("q")).scalar()
        dates = r.select("q", "snapshot_date").distinct()
        shifted = r.select((F.col("q") + 1).alias("q"), "asset_id")
        added = r.select("q", "asset_id").join(shifted, ["q", "asset_id"], "left_anti").withColumn("action", F.lit("added"))
        removed = shifted.join(r, ["q", "asset_id"], "left_anti").withColumn("action", F.lit("removed"))
        flipped = F.when((F.col("asset_id") + F.col("q")) % 13 != 0, F.col("action")).otherwise(
            F.when(F.col("action") == "added", "removed").otherwise("added")
        )
        events = (
            added.unionByName(removed).join(dates, "q").filter(F.col("q") > first_q)
            .select(
                "asset_id",
                F.date_sub("snapshot_date", 20).alias("date"),
                flipped.alias("action"),
                F.explode(F.when(F.col("asset_id") % 11 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
            )
            .drop("col")
        )
        snaps = r.select(
            "asset_id", F.col("snapshot_date").alias("date"),
            F.when(F.col("q") != last_q, "historical").otherwise("current").alias("action"),
        )
        return snaps.unionByName(events).select(
            "asset_id", ticker(F.col("asset_id")).alias("ticker"), "date", "action"
        )

    @cached_property
    def month_ends(self) -> DataFrame:
        return self.calendar.groupBy(F.trunc("dt", "month").alias("m")).agg(F.max("dt").alias("dt"))

    @cached_property
    def requests(self) -> DataFrame:
        """Last session of every month an asset traded in."""
        months = self.daily.select("asset_id", F.trunc("dt", "month").alias("m")).distinct()
        return self.keep(months.join(self.month_ends, "m").select("asset_id", "dt"))

    @cached_property
    def ticker_requests(self) -> DataFrame:
        """Every ticker's months, and a share of unknown tickers."""
        named = F.when(F.col("asset_id") % 19 == 18, F.concat(F.lit("U"), F.col("asset_id").cast("string"))).otherwise(ticker(F.col("asset_id")))
        return self.requests.select(named.alias("ticker"), "dt").distinct()

    @cached_property
    def ranges(self) -> DataFrame:
        """(asset_id, start, end): the 60 days that end at every third month end."""
        return self.requests.filter(F.month("dt") % 3 == 0).select(
            "asset_id", F.date_sub("dt", 60).alias("start"), F.col("dt").alias("end")
        )

    @cached_property
    def orders(self) -> DataFrame:
        """At most one signed order per (asset, day), with a price model."""
        n = F.col("asset_id") % 3
        return self.daily.select(
            F.concat(F.col("dt").cast("string"), F.lit("_"), F.col("asset_id").cast("string")).alias("order_id"),
            "asset_id",
            "dt",
            F.col("net").cast("double").alias("shares"),
            F.when(n == 0, "OPEN").when(n == 1, "CLOSE").otherwise("ARRIVAL").alias("fill_model"),
        )

    @cached_property
    def theta(self) -> DataFrame:
        return self.daily.select("asset_id").distinct().select(
            "asset_id", ((F.col("asset_id") % 7 + 1) * 100000).cast("double").alias("theta")
        )

    @cached_property
    def market_state(self) -> DataFrame:
        from tempora.operators.returns import rolling_market_state

        state = rolling_market_state(self.bars, window=20, keys=["asset_id"], order="dt", price="closeunadj")
        return self.keep(state.filter(F.col("sigma_d").isNotNull()).join(self.theta, "asset_id").select(
            "asset_id", "dt", "sigma_d", "v_d", "theta"
        ))

    @cached_property
    def hourly_curves(self) -> DataFrame:
        from tempora.plans.running import auto_block, running

        hours = (
            self.table("events")
            .groupBy(F.col("event_type").alias("curve_id"), F.date_trunc("hour", "ts").alias("dt"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(_cents("value")).alias("s"))
            .withColumn("m", F.lit(1.0) + F.round(F.col("s") / F.lit(100.0) / F.col("n") - F.lit(50.0), 6) / F.lit(5000.0))
        )
        nav = running(hours, keys=["curve_id"], order=["dt"], exprs={"g": ("product", "m")}, block=auto_block(hours, "dt"))
        return self.keep(nav.select("curve_id", "dt", F.round(F.lit(100.0) * F.col("g"), 8).alias("nav")))

    @cached_property
    def hourly_returns(self) -> DataFrame:
        """(curve_id, idx, r): returns of the hourly curves by position."""
        from tempora.operators.curves import curve_returns
        from tempora.operators.resample import indexed
        from tempora.plans.running import auto_block

        h = curve_returns(self.hourly_curves)
        return self.keep(indexed(h, keys=["curve_id"], order="dt", block=auto_block(h, "dt")).select("curve_id", "idx", "r"))

    @cached_property
    def asset_curves(self) -> DataFrame:
        """One daily curve per asset: 100 x its total return index."""
        from tempora.operators.returns import total_return

        tr = total_return(self.bars, self.dividends, price="closeunadj")
        return self.keep(tr.select(F.col("asset_id").alias("curve_id"), "dt", F.round(F.lit(100.0) * F.col("tr"), 8).alias("nav")))

    @cached_property
    def observations(self) -> DataFrame:
        days = self.table("orders").select(F.to_date("o_orderdate").alias("dt")).distinct()
        return days.select("dt", F.expr("date_add(dt, 3 + cast(datediff(dt, date'1970-01-01') % 9 as int))").alias("label_end"))

    @cached_property
    def trials(self) -> DataFrame:
        c = self.table("customer")
        return c.select(
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("dataset_fingerprint"),
            F.col("c_mktsegment").alias("strategy_family"),
            (F.col("c_acctbal") / F.lit(10000.0)).alias("sr_hat"),
            (F.col("c_custkey") % 90 + 1).cast("int").alias("t_observations"),
            ((F.col("c_custkey") % 5 - 2) / F.lit(10.0)).alias("gamma_3"),
            (F.lit(3.0) + F.col("c_custkey") % 4).alias("gamma_4"),
            F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("metadata"),
        )
