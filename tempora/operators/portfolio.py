"""Weights, trades and portfolio valuation over many curves at once.

Between two rebalances holdings do not change, so the value of a period is a grouped
sum over its assets, and only the period-opening values are chained, over a few
hundred rows per curve.  Nothing walks day by day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import costs as K
from tempora.operators.returns import dividends_per_day
from tempora.operators.scenarios import with_scenarios
from tempora.plans.asof import asof_join
from tempora.plans.intervals import interval_join
from tempora.plans.ranks import ranked
from tempora.plans.running import running
from tempora.session import materialise


def equal_weight(assets: DataFrame, *, keys: Sequence[str] = ("dt",)) -> DataFrame:
    """1/n per asset of each date (or of each group of `keys`)."""
    sizes = assets.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return assets.join(sizes, list(keys)).select(*assets.columns, (1.0 / F.col("__n")).alias("weight"))


def top_quantile(scores: DataFrame, *, q: int = 5, keys: Sequence[str] = ("dt",), asset: str = "asset_id") -> DataFrame:
    """The best max(1, ceil(n/q)) names of each date, equally weighted.

    Order is score descending, asset ascending; a large date is ranked in slices.
    Names without a score (NULL or NaN) are neither chosen nor counted.
    """
    if q < 1:
        raise ValueError(f"q must be >= 1, got {q}")
    keys = list(keys)
    scored = scores.filter(F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")))
    rows = scored.select(*keys, asset, "score", (-F.col("score")).alias("__neg"))
    placed = ranked(rows, keys=keys, order=["__neg", asset], out="__rank", size="__n")
    keep = F.ceil(F.col("__n") / q)
    return placed.filter(F.col("__rank") <= keep).select(*keys, asset, "score", (1.0 / keep).alias("weight"))


def renormalize(weights: DataFrame, bars: DataFrame, *, keys: Sequence[str] = (), at: str = "dt", price: str = "closeunadj") -> DataFrame:
    """Drops names without a positive price that day and rescales the rest; a zero sum gives no rows."""
    px = bars.filter(F.col(price) > 0).select("asset_id", F.col("dt").alias(at), F.col(price).alias("price"))
    live = weights.join(px, ["asset_id", at])
    sums = live.groupBy(*keys, at).agg(F.sum("weight").alias("__sum")).filter(F.col("__sum") != 0)
    return live.join(sums, [*keys, at]).select(*keys, at, "asset_id", "price", (F.col("weight") / F.col("__sum")).alias("weight"))


def target_dollars(weights: DataFrame, nav: DataFrame, *, keys: Sequence[str] = (), at: str = "dt") -> DataFrame:
    """NAV x weight on the dates `nav` lists (the rebalance dates)."""
    return weights.join(nav.select(*keys, at, "nav"), [*keys, at]).withColumn("target_dollars", F.col("nav") * F.col("weight"))


def rebalance_trades(
    targets: DataFrame, *, keys: Sequence[str] = ("curve_id",), at: str = "dt", liquidate_dropped: bool = True, rounding: float = 0.0
) -> DataFrame:
    """Share changes between neighbouring rebalances.

    `targets` has keys, date, asset and shares.  A name missing from the next target
    list is sold there when `liquidate_dropped`; otherwise it is left alone, and its
    next trade starts from the shares it still has.  Targets sized by sums of doubles hang on the order
    of these sums: a change of at most `rounding` times the larger holding is then no change.
    """
    keys = list(keys)
    rows = targets.select(*keys, at, "asset_id", "shares")
    if liquidate_dropped:
        dates = targets.select(*keys, at).distinct()
        # The rebalances of a curve are a calendar-sized list.
        following = running(dates, keys=keys, order=[at], exprs={"next_dt": ("lag", F.col(at))}, descending=True)
        exits = (
            rows.join(following, [*keys, at]).filter(F.col("next_dt").isNotNull())
            .select(*keys, F.col("next_dt").alias(at), "asset_id", F.lit(0.0).alias("shares"))
        )
        exits = exits.join(rows, [*keys, at, "asset_id"], "left_anti")
        rows = rows.unionByName(exits)
    lagged = running(rows, keys=[*keys, "asset_id"], order=[at], exprs={"__held": ("lag", "shares")})
    held = F.coalesce("__held", F.lit(0.0))
    changed = F.col("quantity") != 0
    if rounding:
        changed = changed & (F.abs("quantity") > F.lit(rounding) * F.greatest(F.abs("shares"), F.abs(held)))
    return lagged.withColumn("quantity", F.col("shares") - held).filter(changed).select(*keys, at, "asset_id", "quantity")


#: Trades of a curve that one step of the costed fold reads as an array; a longer history is folded range by range.
TRADES = 1 << 18


class Book:
    """What valuations read more than once, worked out once and written.

    ``prices`` has one row per bar: (asset_id, dt, price, cum_div, until), the price, the dividends paid
    so far and the last day it is carried to.  ``first`` has the names bought at a rebalance with p0 and
    d0, ``periods`` one row per curve and rebalance: (keys, period, dt, next_dt, total weight), and
    ``lines`` the bars of every name while it is held.
    """

    def __init__(self, weights: DataFrame, bars: DataFrame, dividends: DataFrame | None, keys: Sequence[str], price: str) -> None:
        self.keys = list(keys)
        self.sessions = materialise(bars.filter(F.col("dt").isNotNull()).select("dt").distinct())
        self.begin, self.last = self.sessions.agg(F.min("dt"), F.max("dt")).first()
        self.prices = materialise(carried_prices(bars, dividends, self.last, price=price))
        bought = self.prices.filter("price > 0").select("asset_id", "dt", F.col("price").alias("p0"), F.col("cum_div").alias("d0"))
        self.first = materialise(weights.select(*self.keys, "dt", "asset_id", "weight").join(bought, ["asset_id", "dt"]))
        totals = self.first.groupBy(*self.keys, "dt").agg(F.sum("weight").alias("total")).filter(F.col("total") != 0)
        # The rebalances of a curve are a calendar-sized list.
        order = Window.partitionBy(*self.keys).orderBy("dt")
        self.periods = materialise(totals.select("*", F.row_number().over(order).cast("long").alias("period"), F.lead("dt").over(order).alias("next_dt")))
        self.lines = materialise(self._lines())

    def held(self) -> DataFrame:
        """(keys, period, start_dt, next_dt, asset_id, weight, p0, d0): shares of a rebalance add up to 1."""
        rows = self.first.join(self.periods, [*self.keys, "dt"])
        return rows.select(
            *self.keys, "period", F.col("dt").alias("start_dt"), "next_dt", "asset_id", (F.col("weight") / F.col("total")).alias("weight"), "p0", "d0"
        )

    def _lines(self) -> DataFrame:
        """`held` once per bar of the name from the rebalance to the next: with bar_dt, price, cum_div and until, which ends with the period."""
        spans = self.held().withColumn("__end", F.coalesce("next_dt", F.lit(self.last)))
        bars = self.prices.withColumnRenamed("dt", "bar_dt")
        met = interval_join(bars, spans, by=["asset_id"], at="bar_dt", start="start_dt", end="__end")
        return met.withColumn("until", F.least("until", "__end")).drop("__end")


def carried_prices(bars: DataFrame, dividends: DataFrame | None, last, *, price: str) -> DataFrame:
    """Bars with the days they stand for, up to the next bar of the asset or to `last`; see `Book`.

    Dividends meet bars in one grouping by asset and day, and only those on a bar's day count.
    """
    amount = F.lit(None).cast("double")
    rows = bars.select("asset_id", "dt", F.col(price).cast("double").alias("price"), amount.alias("div"))
    if dividends is not None:
        rows = rows.unionByName(dividends.select("asset_id", F.col("ex_date").alias("dt"), amount.alias("price"), F.col("amount_per_share").cast("double").alias("div")))
    # One exchange by asset serves the grouping and the window; an asset has a row per session at most.
    # The number is given, as bars pack so well that Spark would merge the assets into a few large tasks.
    parts = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    days = rows.filter(F.col("dt").isNotNull()).repartition(parts, "asset_id").groupBy("asset_id", "dt").agg(F.max("price").alias("price"), F.sum("div").alias("div"))
    order = Window.partitionBy("asset_id").orderBy("dt")
    paid = F.sum(F.coalesce("div", F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    days = days.filter(F.col("price").isNotNull()).select("asset_id", "dt", "price", paid.alias("cum_div"), F.lead("dt").over(order).alias("__next"))
    return days.select("asset_id", "dt", "price", "cum_div", F.coalesce(F.date_sub("__next", 1), F.lit(last)).alias("until"))


def relative_values(book: Book, *, on_missing: str = "carry") -> DataFrame:
    """(keys, period, start_dt, next_dt, dt, rel): value of each holding period per 1 of opening NAV.

    A period runs to the next rebalance, that date included; the last one runs to the last session.
    `on_missing` decides what a held name without a bar is worth: `carry` its last price, `skip` nothing.
    """
    if on_missing not in ("carry", "skip"):
        raise ValueError("on_missing must be carry or skip")
    # A bar is carried by an explode that goes straight into the sum over assets: only sums are shuffled.
    lines = book.lines.withColumn("dt", F.explode(F.sequence("bar_dt", "until"))).join(book.sessions, "dt", "left_semi")
    # Dividends paid earlier in the period stay in cash even on a day without a price.
    worth = F.col("price") if on_missing == "carry" else F.when(F.col("dt") == F.col("bar_dt"), F.col("price")).otherwise(0.0)
    rel = F.col("weight") * (worth + F.col("cum_div") - F.col("d0")) / F.col("p0")
    return materialise(lines.groupBy(*book.keys, "period", "start_dt", "next_dt", "dt").agg(F.sum(rel).alias("rel")))


def _growth(book: Book, relative: DataFrame) -> DataFrame:
    """(keys, period, start_dt, growth) of every rebalance; NULL growth for the last one."""
    closing = relative.filter(F.col("dt") == F.col("next_dt")).select(*book.keys, "period", F.col("rel").alias("growth"))
    return book.periods.join(closing, [*book.keys, "period"], "left").select(*book.keys, "period", F.col("dt").alias("start_dt"), "growth")


def _expand(book: Book, relative: DataFrame, opening: DataFrame, keys: Sequence[str], capital: float) -> DataFrame:
    """Daily NAV from period values; before the first rebalance a curve is all cash."""
    extra = [c for c in ("n_unquoted",) if c in opening.columns]
    owned = relative.filter(F.col("next_dt").isNull() | (F.col("dt") < F.col("next_dt"))).drop("start_dt")
    nav = owned.join(opening, [*book.keys, "period"]).select(
        *keys, "dt", (F.col("nav_open") * F.col("rel") - F.col("cost") + F.col("marked")).alias("nav"), *extra
    )
    early = opening.filter((F.col("period") == 1) & (F.col("start_dt") > F.lit(book.begin))).select(
        *keys, F.explode(F.sequence(F.lit(book.begin), F.date_sub("start_dt", 1))).alias("dt")
    )
    cash = early.join(book.sessions, "dt", "left_semi").select(*keys, "dt", F.lit(float(capital)).alias("nav"), *[F.lit(0).cast("long").alias(c) for c in extra])
    return nav.unionByName(cash)


def portfolio_nav(
    weights: DataFrame,
    bars: DataFrame,
    dividends: DataFrame | None,
    *,
    keys: Sequence[str] = ("curve_id",),
    capital: float = 1_000_000.0,
    price: str = "closeunadj",
    on_missing: str = "carry",
) -> DataFrame:
    """Daily NAV of each curve at zero cost: (keys, dt, nav).

    `weights` has keys, dt (rebalance date), asset_id and weight.  Every rebalance
    reinvests the whole NAV, cash holds dividends until the next one, and names not
    selected again are sold there.
    """
    book = Book(weights, bars, dividends, keys, price)
    relative = relative_values(book, on_missing=on_missing)
    opening = running(_growth(book, relative), keys=book.keys, order=["period"], exprs={"__g": ("product", "growth")}, exclusive=True).select(
        *book.keys, "period", "start_dt", (F.lit(float(capital)) * F.coalesce("__g", F.lit(1.0))).alias("nav_open"),
        F.lit(0.0).alias("cost"), F.lit(0.0).alias("marked"),
    )
    return _expand(book, relative, opening, book.keys, capital)


def _trades(book: Book, market_state: DataFrame) -> DataFrame:
    """(keys, period, n, trades): what a rebalance buys and gives up per unit of NAV, with price and market state of the day."""
    unit, nothing = F.col("weight") / F.col("p0"), F.lit(None).cast("double")
    now = book.held().select(*book.keys, "period", F.col("start_dt").alias("dt"), "asset_id", unit.alias("unit"), nothing.alias("before"), F.col("p0").alias("price"))
    # The bar that is carried to the next rebalance has the price a name is given up at.
    sold = book.lines.filter(F.col("until") == F.col("next_dt")).select(
        *book.keys, (F.col("period") + 1).alias("period"), F.col("next_dt").alias("dt"), "asset_id", nothing.alias("unit"), unit.alias("before"), "price"
    )
    moves = now.unionByName(sold).groupBy(*book.keys, "period", "dt", "asset_id").agg(
        F.coalesce(F.max("unit"), F.lit(0.0)).alias("unit"), F.coalesce(F.max("before"), F.lit(0.0)).alias("before"), F.max("price").alias("price")
    )
    quoted = moves.join(market_state.select("asset_id", "dt", "sigma_d", "v_d", "theta"), ["asset_id", "dt"], "left")
    line = F.struct("asset_id", "dt", "unit", "before", "price", "sigma_d", "v_d", "theta")
    # A rebalance has one line per name at most.
    return quoted.groupBy(*book.keys, "period").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(line)).alias("trades"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def costed_nav_path(
    weights: DataFrame,
    bars: DataFrame,
    dividends: DataFrame | None,
    market_state: DataFrame,
    *,
    keys: Sequence[str] = ("curve_id",),
    capital: float = 1_000_000.0,
    price: str = "closeunadj",
    eta: Column | float = K.ETA,
    beta: Column | float = K.BETA,
    gamma: Column | float = K.GAMMA,
    commission_per_share: Column | float = 0.0,
    commission_bps: Column | float = 0.0,
    impact_on_prices: bool = False,
    mark_impact: bool = True,
    grid: tuple[str, Sequence[float]] | None = None,
    strict: bool = False,
    trades_per_range: int = TRADES,
) -> tuple[DataFrame, DataFrame, Book]:
    """(opening, relative, book) of curves that pay impact and commission at each rebalance.

    Opening values obey nav[k+1] = nav[k] x growth[k] - cost[k](nav[k], nav[k-1]): the
    cost of a rebalance is a sum over assets of a nonlinear function of two numbers.
    A curve's rebalances are one array, its trades arrays within, and one fold over it
    carries the two numbers, so the number of jobs does not depend on the rebalances.  A curve of more
    than `trades_per_range` trades is cut into ranges of rebalances, each folded from the state the
    range before left.  Runs actions.

    `grid` = (name, values) adds a scenario key; cost parameters may refer to it as
    F.col(name).  Holding-period values do not depend on it and are computed once.
    A trade without a usable market state on its day pays commission only; opening counts
    such trades in n_unquoted, and `strict` makes the first of them an error.

    `impact_on_prices` fills at prices moved by all earlier permanent impact; targets are
    still sized on raw prices.  Daily marks then include the impact (a constant per
    period, since it only moves at rebalances) unless `mark_impact` is off.
    """
    book = Book(weights, bars, dividends, keys, price)
    relative = relative_values(book)
    base = book.keys
    steps = _growth(book, relative).join(_trades(book, market_state), [*base, "period"])
    so_far = F.sum("n").over(Window.partitionBy(*base).orderBy("period").rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumn("range", F.floor(F.coalesce(so_far, F.lit(0)) / trades_per_range).cast("int"))
    curves = steps.groupBy(*base, "range").agg(F.sort_array(F.collect_list(F.struct("period", "start_dt", "growth", "trades"))).alias("steps"))
    full = list(base)
    if grid is not None:
        full = [*base, grid[0]]
        # Scenarios of one curve go to different tasks.
        curves = with_scenarios(curves, *grid).drop("scenario_no").repartition(*full)
    curves = materialise(curves)
    register = f"map<{dict(bars.dtypes)['asset_id']},double>"
    line = "array<struct<period:bigint,start_dt:date,nav_open:double,nav_before:double,cost:double,marked:double,n_unquoted:bigint>>"
    fresh = [F.lit(float(capital)).alias("now"), F.lit(None).cast("double").alias("before"), F.create_map().cast(register).alias("moved"), F.array().cast(line).alias("path")]

    def step(state: Column, x: Column) -> Column:
        def shares(t: Column) -> Column:
            return F.struct(
                t["asset_id"].alias("asset_id"), t["dt"].alias("dt"), (t["unit"] * state["now"]).alias("held"),
                (t["unit"] * state["now"] - t["before"] * F.coalesce(state["before"], F.lit(0.0))).alias("q"), t["price"].alias("price"),
                t["sigma_d"].alias("sigma_d"), t["v_d"].alias("v_d"), t["theta"].alias("theta"),
                (F.coalesce(state["moved"][t["asset_id"]], F.lit(0.0)) if impact_on_prices else F.lit(0.0)).alias("shift"),
            )

        def impact(t: Column) -> Column:
            perm, temp = K.impact_bps(t["q"], t["sigma_d"], t["v_d"], t["theta"], eta=eta, beta=beta, gamma=gamma)
            unquoted = (t["q"] != 0) & perm.isNull()
            if strict:
                named = F.concat(F.lit("no market state: asset "), t["asset_id"].cast("string"), F.lit(" on "), t["dt"].cast("string"))
                unquoted = F.when(unquoted, F.raise_error(named).cast("boolean")).otherwise(F.lit(False))
            fill = (t["price"] + t["shift"]) * (1.0 + F.signum(t["q"]) * F.coalesce(temp, F.lit(0.0)) / K.BPS)
            return F.struct(
                t["asset_id"].alias("asset_id"), t["held"].alias("held"), t["q"].alias("q"), t["price"].alias("price"), t["shift"].alias("shift"),
                fill.alias("fill"), (F.signum(t["q"]) * F.coalesce(perm, F.lit(0.0)) / K.BPS).alias("push"), unquoted.alias("unquoted"),
            )

        def paid(t: Column) -> Column:
            after = t["shift"] + t["push"] * t["fill"] if impact_on_prices else F.lit(0.0)
            fees = K.per_share_commission(t["q"], commission_per_share) + K.notional_commission(t["q"] * t["fill"], commission_bps)
            return F.struct(
                t["asset_id"].alias("asset_id"), (t["q"] * (t["fill"] - t["price"]) + fees).alias("paid"), (t["held"] * after).alias("marked"),
                t["unquoted"].cast("long").alias("unquoted"), after.alias("after"),
            )

        def close(lines: Column) -> Column:
            none = F.struct(F.lit(0.0).alias("cost"), F.lit(0.0).alias("marked"), F.lit(0).cast("long").alias("n"))
            sums = F.aggregate(lines, none, lambda s, t: F.struct(
                (s["cost"] + F.coalesce(t["paid"], F.lit(0.0))).alias("cost"), (s["marked"] + F.coalesce(t["marked"], F.lit(0.0))).alias("marked"), (s["n"] + t["unquoted"]).alias("n"),
            ))
            moved = state["moved"]
            if impact_on_prices:
                entries = F.map_from_entries(F.transform(lines, lambda t: F.struct(t["asset_id"], t["after"])))
                moved = F.map_zip_with(moved, entries, lambda _, old, new: F.coalesce(new, old))
            return _let(sums, lambda s: F.struct(
                (state["now"] * x["growth"] - s["cost"]).alias("now"), state["now"].alias("before"), moved.alias("moved"),
                F.concat(state["path"], F.array(F.struct(
                    x["period"].alias("period"), x["start_dt"].alias("start_dt"), state["now"].alias("nav_open"), state["before"].alias("nav_before"),
                    s["cost"].alias("cost"), (s["marked"] if mark_impact else F.lit(0.0)).alias("marked"), s["n"].alias("n_unquoted"),
                ))).alias("path"),
            ))

        return _let(F.transform(F.transform(F.transform(x["trades"], shares), impact), paid), close)

    opening, carried = None, None
    for part in range((curves.agg(F.max("range")).first()[0] or 0) + 1):
        mine = curves.filter(F.col("range") == part)
        begin = F.struct(*fresh)
        if carried is not None:
            mine = mine.join(carried, full)
            begin = F.struct(F.col("__state.now").alias("now"), F.col("__state.before").alias("before"), F.col("__state.moved").alias("moved"), fresh[3])
        folded = materialise(mine.select(*full, F.aggregate("steps", begin, step).alias("__state")))
        carried = folded
        rows = folded.select(*full, F.inline("__state.path"))
        opening = rows if opening is None else opening.unionByName(rows)
    return opening, relative, book


def portfolio_nav_costed(
    weights: DataFrame, bars: DataFrame, dividends: DataFrame | None, market_state: DataFrame, *,
    keys: Sequence[str] = ("curve_id",), capital: float = 1_000_000.0, **costs,
) -> DataFrame:
    """Daily NAV with trade costs: (keys, dt, nav, n_unquoted, status).  See `costed_nav_path`.

    n_unquoted counts the trades of the day's holding period that had no usable market state, and
    status is `no_market_state` where there are any, as such a period's costs are too low.
    """
    opening, relative, book = costed_nav_path(weights, bars, dividends, market_state, keys=keys, capital=capital, **costs)
    full = [*keys, costs["grid"][0]] if costs.get("grid") else list(keys)
    nav = _expand(book, relative, opening, full, capital)
    return nav.withColumn("status", F.when(F.col("n_unquoted") > 0, "no_market_state").otherwise("ok"))


def dividend_income(positions: DataFrame, dividends: DataFrame, *, keys: Sequence[str] = ("curve_id",)) -> DataFrame:
    """Shares held at the end of the bar before x dividend, per curve and day.

    `positions` has keys, dt, asset_id and shares on every bar.
    """
    keys = list(keys)
    paid = dividends_per_day(dividends, ["asset_id"]).withColumnRenamed("ex_date", "dt")
    held = running(positions, keys=[*keys, "asset_id"], order=["dt"], exprs={"__before": ("lag", "shares")})
    return held.join(paid, ["asset_id", "dt"]).groupBy(*keys, "dt").agg(
        F.sum(F.coalesce("__before", F.lit(0.0)) * F.col("div")).alias("income")
    )


def mark_to_market(
    positions: DataFrame, cash: DataFrame, bars: DataFrame, *, keys: Sequence[str] = ("curve_id",), price: str = "closeunadj",
    on_missing: str = "skip",
) -> DataFrame:
    """cash + sum(shares x price) per curve and day.

    `on_missing`: skip leaves unpriced names out, flag does too but counts them in
    `n_unpriced` with status `unpriced`, carry uses the last price before.
    """
    if on_missing not in ("skip", "flag", "carry"):
        raise ValueError("on_missing must be skip, flag or carry")
    keys = list(keys)
    open_ = positions.filter(F.col("shares") != 0)
    px = bars.select("asset_id", "dt", F.col(price).alias("__px"))
    if on_missing == "carry":
        marked = asof_join(open_, px.withColumnRenamed("dt", "__d"), by=["asset_id"], left_ts="dt", right_ts="__d", payload=["__px"], right_unique=True)
    else:
        marked = open_.join(px, ["asset_id", "dt"], "left")
    value = marked.groupBy(*keys, "dt").agg(
        F.coalesce(F.sum(F.col("shares") * F.col("__px")), F.lit(0.0)).alias("__v"),
        F.count(F.when(F.col("__px").isNull(), 1)).alias("n_unpriced"),
    )
    out = cash.join(value, [*keys, "dt"], "left").select(
        *keys, "dt", (F.col("cash") + F.coalesce("__v", F.lit(0.0))).alias("nav"),
        F.coalesce("n_unpriced", F.lit(0)).alias("n_unpriced"),
    )
    if on_missing == "flag":
        return out.withColumn("status", F.when(F.col("n_unpriced") > 0, "unpriced").otherwise("ok"))
    return out


def curve_summary(curves: DataFrame, rebalances: DataFrame | None = None, *, keys: Sequence[str] = ("curve_id",), capital: float) -> DataFrame:
    """Final NAV, profit, number of days and of rebalances per curve."""
    out = curves.groupBy(*keys).agg(F.max_by("nav", "dt").alias("final_nav"), F.count(F.lit(1)).alias("n_days"))
    out = out.withColumn("final_pnl", F.col("final_nav") - F.lit(float(capital)))
    if rebalances is None:
        return out.withColumn("n_rebalances", F.lit(0).cast("long"))
    n = rebalances.select(*keys, "dt").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rebalances"))
    return out.join(n, list(keys), "left").withColumn("n_rebalances", F.coalesce("n_rebalances", F.lit(0)))


def diff_curves(a: DataFrame, b: DataFrame, *, keys: Sequence[str] = ("curve_id",), tolerance: float) -> DataFrame:
    """Largest absolute difference per curve, rows only one side has, and a verdict."""
    on = [*keys, "dt"]
    both = a.select(*on, F.col("nav").alias("__a")).join(b.select(*on, F.col("nav").alias("__b")), on, "full_outer")
    one_sided = F.col("__a").isNull() | F.col("__b").isNull()
    out = both.groupBy(*keys).agg(
        F.max(F.abs(F.col("__a") - F.col("__b"))).alias("max_abs_diff"), F.count(F.when(one_sided, 1)).alias("n_unmatched")
    )
    return out.withColumn("agrees", (F.col("n_unmatched") == 0) & (F.coalesce("max_abs_diff", F.lit(0.0)) < tolerance))
