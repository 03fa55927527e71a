"""Statistics of value curves: (keys, dt, nav).

Running steps use `auto_block`, so a curve over free timestamps is scanned in
calendar blocks and a daily curve, bounded by its sessions, in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import normal as N
from tempora.operators.returns import pct_change
from tempora.plans.running import auto_block, islands, running

KEYS = ("curve_id",)


def curve_returns(curves: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per-bar returns (the first bar of a curve has none)."""
    out = pct_change(curves, keys=keys, order="dt", value="nav", out="r", block=auto_block(curves, "dt"))
    return out.filter(F.col("r").isNotNull())


def sharpe(returns: DataFrame, *, keys: Sequence[str] = KEYS, flat_is_zero: bool = False, curves: DataFrame | None = None) -> DataFrame:
    """mean / sample deviation per period; status too_short or flat otherwise.

    A curve of one bar has no return; with `curves` it gets its too_short row.
    """
    agg = returns.groupBy(*keys).agg(F.count("r").alias("n"), F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("std_r"))
    if curves is not None:
        agg = curves.select(*keys).distinct().join(agg, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    status = F.when(F.col("n") < 2, "too_short").when(F.col("std_r") == 0, "flat").otherwise("ok")
    ratio = F.when(F.col("status") == "ok", F.col("mean_r") / F.col("std_r"))
    out = agg.withColumn("status", status)
    return out.withColumn("sr_hat", F.coalesce(ratio, F.lit(0.0)) if flat_is_zero else ratio)


def moments(returns: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Biased skewness and non-excess kurtosis (3 for a normal)."""
    return returns.groupBy(*keys).agg(F.skewness("r").alias("gamma_3"), (F.kurtosis("r") + 3.0).alias("gamma_4"))


def underwater(curves: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Curves with the running peak and the relative distance below it."""
    peaked = running(curves, keys=list(keys), order=["dt"], exprs={"peak": ("max", "nav")}, block=auto_block(curves, "dt"))
    return peaked.withColumn("drawdown", F.when(F.col("peak") != 0, (F.col("nav") - F.col("peak")) / F.col("peak")))


def max_drawdown(curves: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Deepest fall from a peak as a positive fraction."""
    agg = underwater(curves, keys=keys).groupBy(*keys).agg(
        F.min("drawdown").alias("__dd"), F.count(F.lit(1)).alias("__n"), F.min_by("nav", "dt").alias("__first")
    )
    status = F.when(F.col("__n") < 2, "too_short").when(F.col("__first") <= 0, "non_positive_start").otherwise("ok")
    out = agg.withColumn("status", status)
    return out.select(*keys, F.when(F.col("status") == "ok", -F.col("__dd") + 0.0).alias("max_drawdown"), "status")


def drawdown_duration(curves: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Longest run below the peak: bars, censored at the end, peak date, trough date.

    The earliest run wins a tie; the trough is the earliest lowest bar of the run.
    """
    keys = list(keys)
    block = auto_block(curves, "dt")
    wet = underwater(curves, keys=keys).withColumn("__wet", F.col("nav") < F.col("peak"))
    dry = running(
        wet, keys=keys, order=["dt"], block=block,
        exprs={"__run": ("sum", F.when(F.col("__wet"), 0).otherwise(1)), "__prev": ("lag", F.col("dt"))},
    )
    runs = dry.filter("__wet").groupBy(*keys, "__run").agg(
        F.count(F.lit(1)).alias("bars"), F.min("dt").alias("start_dt"), F.max("dt").alias("end_dt"),
        F.min_by("__prev", "dt").alias("peak_dt"), F.min_by("dt", F.struct("nav", "dt")).alias("trough_dt"),
    )
    # Longest first, then earliest: one row per curve through a grouped maximum.
    best = runs.groupBy(*keys).agg(
        F.min_by(F.struct("bars", "end_dt", "peak_dt", "trough_dt"), F.struct((-F.col("bars")).alias("b"), "start_dt")).alias("best")
    )
    ends = curves.groupBy(*keys).agg(F.min("dt").alias("__first"), F.max("dt").alias("__last"))
    joined = ends.join(best, keys, "left")
    return joined.select(
        *keys, F.coalesce("best.bars", F.lit(0)).alias("duration_bars"),
        F.coalesce(F.col("best.end_dt") == F.col("__last"), F.lit(False)).alias("censored"),
        F.coalesce("best.peak_dt", "__first").alias("peak_dt"), F.col("best.trough_dt").alias("trough_dt"),
    )


def growth(curves: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n_bars, first_nav, last_nav, first_dt, last_dt)."""
    return curves.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"), F.min_by("nav", "dt").alias("first_nav"), F.max_by("nav", "dt").alias("last_nav"),
        F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"),
    )


def relative_change(first: str, last: str) -> Column:
    """last / first - 1, NULL for a zero start."""
    return F.when(F.col(first) != 0, F.col(last) / F.col(first) - 1.0)


def annual_growth(first: Column, last: Column, n_bars: Column, periods_per_year: int) -> Column:
    """NULL for a curve of one bar or one that does not start above zero."""
    return F.when((first > 0) & (n_bars > 1), F.pow(last / first, F.lit(float(periods_per_year)) / (n_bars - 1)) - 1.0)


# Fixed value: bars a Calmar ratio needs.
CALMAR_MIN_BARS = 21


def calmar(curves: DataFrame, *, keys: Sequence[str] = KEYS, periods_per_year: int = 252) -> DataFrame:
    """Annual growth over maximum drawdown, with a status when it is undefined."""
    keys = list(keys)
    both = growth(curves, keys=keys).join(max_drawdown(curves, keys=keys).drop("status"), keys)
    status = (
        F.when(F.col("n_bars") < CALMAR_MIN_BARS, "too_short").when(F.col("first_nav") <= 0, "non_positive_start")
        .when(F.col("max_drawdown") == 0, "no_drawdown").otherwise("ok")
    )
    ratio = annual_growth(F.col("first_nav"), F.col("last_nav"), F.col("n_bars"), periods_per_year) / F.col("max_drawdown")
    out = both.withColumn("status", status)
    return out.select(*keys, F.when(F.col("status") == "ok", ratio).alias("calmar"), "status")


def hhi(pnl: DataFrame, *, keys: Sequence[str] = KEYS, value: str = "pnl") -> DataFrame:
    """Concentration of absolute profit over bars: sum of squared shares."""
    agg = pnl.groupBy(*keys).agg(F.sum(F.abs(value)).alias("__t"), F.sum(F.col(value) * F.col(value)).alias("__q"))
    status = F.when(F.col("__t").isNull(), "all_null").when(F.col("__t") == 0, "zero_total").otherwise("ok")
    out = agg.withColumn("status", status)
    return out.select(*keys, F.when(F.col("status") == "ok", F.col("__q") / (F.col("__t") * F.col("__t"))).alias("hhi"), "status")


def longest_runs(returns: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Longest winning and losing streak; a zero return breaks both."""
    keys = list(keys)
    block = auto_block(returns, "dt")
    signed = returns.withColumn("__sign", F.signum("r").cast("int"))
    numbered = islands(signed, keys=keys, order=["dt"], flag=F.col("__sign"), out="__run", block=block)
    runs = numbered.groupBy(*keys, "__run").agg(F.count(F.lit(1)).alias("__len"), F.max("__sign").alias("__s"))
    return runs.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("__s") > 0, F.col("__len"))), F.lit(0)).alias("longest_win"),
        F.coalesce(F.max(F.when(F.col("__s") < 0, F.col("__len"))), F.lit(0)).alias("longest_loss"),
    )


def by_year(curves: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last over first value of each calendar year (years stand alone); NULL where the first is zero."""
    ends = curves.groupBy(*keys, F.year("dt").alias("year")).agg(F.max_by("nav", "dt").alias("__l"), F.min_by("nav", "dt").alias("__f"))
    return ends.select(*keys, "year", relative_change("__f", "__l").alias("year_return"))


def performance(curves: DataFrame, *, keys: Sequence[str] = KEYS, periods_per_year: int = 252) -> DataFrame:
    keys = list(keys)
    g = growth(curves, keys=keys).join(sharpe(curve_returns(curves, keys=keys), keys=keys).select(*keys, "std_r"), keys, "left")
    return g.select(
        *keys, relative_change("first_nav", "last_nav").alias("total_return"),
        annual_growth(F.col("first_nav"), F.col("last_nav"), F.col("n_bars"), periods_per_year).alias("annualized_return"),
        (F.col("std_r") * F.sqrt(F.lit(float(periods_per_year)))).alias("annualized_volatility"),
    )


def sharpe_inference(
    stats: DataFrame, *, sr_star: float = 0.0, alpha: float = 0.05, v_sr: Column | None = None, n_trials: Column | None = None
) -> DataFrame:
    """Adds psr, dsr and min_trl (rounded up) to rows of sr_hat, n, gamma_3, gamma_4."""
    star = F.lit(float(sr_star))
    sr, t, g3, g4 = F.col("sr_hat"), F.col("n"), F.col("gamma_3"), F.col("gamma_4")
    v_sr = F.lit(0.0) if v_sr is None else v_sr
    n_trials = F.lit(1) if n_trials is None else n_trials
    return (
        stats.withColumn("psr", N.psr(sr, star, t, g3, g4))
        .withColumn("dsr", N.dsr(sr, t, g3, g4, v_sr, n_trials))
        .withColumn("min_trl", F.ceil(N.min_trl(sr, star, alpha, g3, g4)).cast("long"))
    )


def scorecard(
    curves: DataFrame, *, keys: Sequence[str] = KEYS, periods_per_year: int = 252, sr_star: float = 0.0, alpha: float = 0.05,
    trials: DataFrame | None = None,
) -> DataFrame:
    """One row per curve with every statistic.

    Two passes over the curves feed it: one keyed scan for returns, peaks and run ids,
    shared by all grouped statistics.  `trials` (keys, n_trials, v_sr) sets the
    multiple-testing context; without it a curve counts as a single trial.
    """
    keys = list(keys)
    block = auto_block(curves, "dt")
    scan = running(
        curves, keys=keys, order=["dt"], block=block,
        exprs={"__pn": ("lag", "nav"), "__pd": ("lag", "dt"), "__peak": ("max", "nav")},
    )
    r = F.when(F.col("__pn") != 0, F.col("nav") / F.col("__pn") - 1.0)
    scan = scan.withColumn("r", r).withColumn("__wet", F.col("nav") < F.col("__peak")).withColumn("__sign", F.signum("r").cast("int"))
    scan = running(scan, keys=keys, order=["dt"], block=block, exprs={"__ps": ("lag", "__sign")})
    scan = running(
        scan, keys=keys, order=["dt"], block=block,
        exprs={
            "__wrun": ("sum", F.when(F.col("__wet"), 0).otherwise(1)),
            "__srun": ("sum", F.when(F.col("__ps").eqNullSafe(F.col("__sign")), 0).otherwise(1)),
        },
    )
    general = scan.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"), F.count("r").alias("n"), F.min("dt").alias("start_dt"), F.max("dt").alias("end_dt"),
        F.min_by("nav", "dt").alias("first_nav"), F.max_by("nav", "dt").alias("last_nav"),
        F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("std_r"), F.skewness("r").alias("gamma_3"),
        (F.kurtosis("r") + 3.0).alias("gamma_4"),
        F.min(F.when(F.col("__peak") != 0, (F.col("nav") - F.col("__peak")) / F.col("__peak"))).alias("__dd"),
    )
    streaks = scan.filter(F.col("r").isNotNull()).groupBy(*keys, "__srun").agg(F.count(F.lit(1)).alias("l"), F.max("__sign").alias("s")).groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("s") > 0, F.col("l"))), F.lit(0)).alias("longest_win"),
        F.coalesce(F.max(F.when(F.col("s") < 0, F.col("l"))), F.lit(0)).alias("longest_loss"),
    )
    wet = scan.filter("__wet").groupBy(*keys, "__wrun").agg(
        F.count(F.lit(1)).alias("bars"), F.min("dt").alias("start"), F.max("dt").alias("end"),
        F.min_by("__pd", "dt").alias("peak"), F.min_by("dt", F.struct("nav", "dt")).alias("trough"),
    ).groupBy(*keys).agg(
        F.min_by(F.struct("bars", "end", "peak", "trough"), F.struct((-F.col("bars")).alias("b"), "start")).alias("w")
    )
    out = general.join(streaks, keys, "left").join(wet, keys, "left")
    status = (
        F.when(F.col("n") < 2, "too_short").when(F.col("first_nav") <= 0, "non_positive_start").when(F.col("std_r") == 0, "flat").otherwise("ok")
    )
    out = out.withColumn("status", status).withColumn("sr_hat", F.when(F.col("status") == "ok", F.col("mean_r") / F.col("std_r")))
    if trials is not None:
        out = out.join(trials.select(*keys, "n_trials", "v_sr"), keys, "left")
        out = sharpe_inference(out, sr_star=sr_star, alpha=alpha, v_sr=F.col("v_sr"), n_trials=F.col("n_trials"))
    else:
        out = sharpe_inference(out, sr_star=sr_star, alpha=alpha)
    return out.select(
        *keys, "status", "n_bars", "start_dt", "end_dt",
        relative_change("first_nav", "last_nav").alias("total_return"),
        annual_growth(F.col("first_nav"), F.col("last_nav"), F.col("n_bars"), periods_per_year).alias("annualized_return"),
        (F.col("std_r") * F.sqrt(F.lit(float(periods_per_year)))).alias("annualized_volatility"),
        (-F.col("__dd") + 0.0).alias("max_drawdown"),
        F.coalesce("w.bars", F.lit(0)).alias("duration_bars"),
        F.coalesce(F.col("w.end") == F.col("end_dt"), F.lit(False)).alias("censored"),
        F.coalesce("w.peak", "start_dt").alias("peak_dt"), F.col("w.trough").alias("trough_dt"),
        F.coalesce("longest_win", F.lit(0)).alias("longest_win"), F.coalesce("longest_loss", F.lit(0)).alias("longest_loss"),
        "sr_hat", "psr", "dsr", "min_trl",
    )


def sections(card: DataFrame, years: DataFrame | None = None, shortfall: DataFrame | None = None, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """The scorecard as six nested sections, with year returns as a map."""
    keys = list(keys)
    out = card
    if years is not None:
        # One entry per calendar year and curve.
        maps = years.groupBy(*keys).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "year_return")))).alias("by_year")
        )
        out = out.join(maps, keys, "left")
    else:
        out = out.withColumn("by_year", F.lit(None).cast("map<int,double>"))
    costs = ["slippage_bps", "temporary_impact_bps", "permanent_impact_bps", "commission"]
    if shortfall is not None:
        out = out.join(shortfall.select(*keys, *costs), keys, "left")
    else:
        for c in costs:
            out = out.withColumn(c, F.lit(0.0))
    return out.select(
        *keys,
        F.struct("n_bars", "start_dt", "end_dt").alias("general"),
        F.struct("total_return", "annualized_return", "annualized_volatility").alias("performance"),
        F.struct("max_drawdown", "duration_bars", "censored", "peak_dt", "trough_dt", "longest_win", "longest_loss").alias("runs_and_drawdowns"),
        F.struct(*costs).alias("implementation_shortfall"),
        F.struct("sr_hat", "psr", "dsr", "min_trl").alias("risk_adjusted"),
        F.struct("by_year").alias("attribution"),
    )
