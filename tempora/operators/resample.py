"""Percentiles, autocorrelation and the stationary bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.plans.ranks import attach, kth_smallest
from tempora.plans.running import index_block, running

# Fixed value: below this many paths a distribution is called a small sample.
STABLE_COUNT = 30
#: Positions of a series that one task sums lag products over.
LAG_BLOCK = 1 << 12


def nearest_rank(df: DataFrame, *, keys: Sequence[str], value: str, pcts: Sequence[float]) -> DataFrame:
    """sorted[max(1, ceil(p/100 n))] per key and percentile, never interpolated."""
    bad = [p for p in pcts if not 0.0 <= p <= 100.0]
    if bad:
        raise ValueError(f"percentiles must lie in [0, 100], got {bad}")
    keys = list(keys)
    v = F.col(value)
    sizes = df.groupBy(*keys).agg(F.count(v).alias("n"), F.count(F.when(F.isnan(v.cast("double")), 1)).alias("__nan"))
    asked = sizes.withColumn("pct", F.explode(F.array(*[F.lit(float(p)) for p in pcts]))).withColumn(
        "k", F.greatest(F.lit(1), F.ceil(F.col("pct") / 100.0 * F.col("n"))).cast("long")
    )
    out = kth_smallest(df, asked, keys=keys, value=value, out="value")
    status = F.when(F.col("n") == 0, "empty").when(F.col("__nan") > 0, "nan").otherwise("ok")
    return out.select(
        *keys, "pct", "n", F.when(status == "ok", F.col("value")).alias("value"), (F.col("n") < STABLE_COUNT).alias("low_sample"),
        status.alias("status"),
    )


def nearest_rank_small(df: DataFrame, *, keys: Sequence[str], value: str, pcts: Sequence[float]) -> DataFrame:
    """`nearest_rank` for groups whose size is a parameter (paths, scenarios): one aggregation."""
    cut = [F.expr(f"percentile_disc({float(p) / 100.0!r}) WITHIN GROUP (ORDER BY {value})") for p in pcts]
    agg = df.groupBy(*keys).agg(
        F.array(*[F.struct(F.lit(float(p)).alias("pct"), c.alias("value")) for p, c in zip(pcts, cut)]).alias("__v"),
        F.count(value).alias("n"),
    )
    return agg.select(*keys, "n", F.explode("__v").alias("v")).select(
        *keys, "v.pct", "n", "v.value", (F.col("n") < STABLE_COUNT).alias("low_sample"), F.lit("ok").alias("status")
    )


def indexed(series: DataFrame, *, keys: Sequence[str], order: str, block: Column | None = None) -> DataFrame:
    """Adds idx, the position from 0 inside each key."""
    out = running(series, keys=list(keys), order=[order], exprs={"__n": ("count", F.lit(1))}, block=block)
    return out.withColumn("idx", F.col("__n") - 1).drop("__n")


def autocorrelation(
    series: DataFrame, *, keys: Sequence[str], value: str, max_lag: int, index: str = "idx", rows_per_block: int = LAG_BLOCK
) -> DataFrame:
    """cov(lag)/var with the full-sample mean; `series` has a position column without gaps.

    Positions are cut into blocks, and a block gets the first `max_lag` values of the next one as a
    halo, so it sums all its lag products by itself: the series is exchanged once, whatever the lags.
    """
    keys = list(keys)
    size = max(rows_per_block, max_lag)
    stats = series.groupBy(*keys).agg(
        F.avg(value).alias("__m"), F.count(value).alias("n"), (F.var_pop(value) * F.count(value)).alias("__v")
    )
    home = F.floor(F.col(index) / size)
    centred = attach(series.select(*keys, index, value), stats.select(*keys, "__m"), keys).select(
        *keys, index, (F.col(value) - F.col("__m")).alias("x"), home.alias("__home")
    )
    lent = (F.col("__home") > 0) & (F.col(index) % size < max_lag)
    dealt = centred.withColumn("__b", F.explode(F.when(lent, F.array("__home", F.col("__home") - 1)).otherwise(F.array("__home"))))
    blocks = dealt.groupBy(*keys, "__b").agg(
        F.sort_array(F.collect_list(F.struct(index, "x"))).alias("__x"), F.count(F.when(F.col("__home") == F.col("__b"), 1)).cast("int").alias("__own")
    )

    def product(lag: Column):
        pair = lambda i: F.get("__x", i)["x"] * F.get("__x", i + lag)["x"]
        return F.aggregate(F.sequence(F.lit(0), F.col("__own") - 1), F.lit(0.0), lambda acc, i: acc + F.coalesce(pair(i), F.lit(0.0)))

    lags = F.sequence(F.lit(1), F.lit(max_lag))
    sums = blocks.select(*keys, F.posexplode(F.transform(lags, product)).alias("__at", "__c"))
    cov = sums.groupBy(*keys, (F.col("__at") + 1).alias("lag")).agg(F.sum("__c").alias("__c"))
    every = stats.select(*keys, "n", "__v", F.explode(lags).alias("lag"))
    value_ = F.when((F.col("__v") > 0) & (F.col("n") > F.col("lag")), F.coalesce("__c", F.lit(0.0)) / F.col("__v")).otherwise(0.0)
    return every.join(cov, keys + ["lag"], "left").select(*keys, "lag", value_.alias("acf"), "n")


def block_length(acf: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Largest lag beyond 2/sqrt(n), plus one, at least 2; 2 for fewer than 3 values."""
    hit = F.max(F.when((F.abs("acf") > 2.0 / F.sqrt("n")) & (F.col("n") >= 3), F.col("lag")))
    return acf.groupBy(*keys).agg(F.greatest(F.lit(2.0), (F.coalesce(hit, F.lit(1)) + 1).cast("double")).alias("block_length"))


def hashed_uniform(seed: int, *parts: Column) -> Column:
    """Uniform in [0, 1) from md5, the same whatever the layout of the data."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def stationary_bootstrap(
    series: DataFrame, *, keys: Sequence[str], value: str, n_paths: int, block_length: float | Column, seed: int, index: str = "idx",
) -> DataFrame:
    """(keys, path, step, idx, value): resampled paths as long as the series.

    Every step restarts at a uniform position with probability 1/L and else takes the
    next value, wrapping around.  The restart flags are independent, so the block a
    step belongs to is the newest restart at or before it, and its source position is
    (start + steps since) mod n.  Paths and blocks of steps are scanned in parallel.
    """
    if not isinstance(block_length, Column):
        if block_length <= 1.0:
            raise ValueError(f"block_length must exceed 1, got {block_length}")
        block_length = F.lit(float(block_length))
    if n_paths < 1:
        raise ValueError(f"n_paths must be >= 1, got {n_paths}")
    keys = list(keys)
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    # Each source row spawns one step of every path: no cross join, no driver loop.
    steps = series.select(*keys, F.col(index).alias("step"), F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))).alias("path"))
    steps = steps.join(sizes, keys)
    labels = [F.col(k) for k in keys] + [F.col("path"), F.col("step")]
    fresh = (F.col("step") == 0) | (hashed_uniform(seed, *labels, F.lit("r")) < 1.0 / block_length)
    start = F.floor(hashed_uniform(seed, *labels, F.lit("s")) * F.col("__size")).cast("long")
    marked = steps.withColumn("__at", F.when(fresh, F.struct(F.col("step").alias("at"), start.alias("start"))))
    scanned = running(
        marked, keys=keys + ["path"], order=["step"], exprs={"__b": ("last", "__at")}, block=index_block("step")
    )
    placed = scanned.select(
        *keys, "path", "step", ((F.col("__b.start") + F.col("step") - F.col("__b.at")) % F.col("__size")).cast("long").alias(index)
    )
    return placed.join(series.select(*keys, index, value), keys + [index]).select(*keys, "path", "step", index, value)


def bootstrap_blocks(
    series: DataFrame, *, keys: Sequence[str], n_paths: int, block_length: float | Column, seed: int, index: str = "idx"
) -> DataFrame:
    """(keys, path, at, start, length, size): the blocks that the paths of `stationary_bootstrap` are made of.

    A block is the steps from a restart up to the next one; they are consecutive values of the series
    from `start` on, wrapping around.  A path has about 1/L as many blocks as steps.
    """
    if not isinstance(block_length, Column):
        if block_length <= 1.0:
            raise ValueError(f"block_length must exceed 1, got {block_length}")
        block_length = F.lit(float(block_length))
    if n_paths < 1:
        raise ValueError(f"n_paths must be >= 1, got {n_paths}")
    keys = list(keys)
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    steps = attach(series.select(*keys, F.col(index).alias("at")), sizes, keys).withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))))
    labels = [F.col(k) for k in keys] + [F.col("path"), F.col("at")]
    fresh = (F.col("at") == 0) | (hashed_uniform(seed, *labels, F.lit("r")) < 1.0 / block_length)
    start = F.floor(hashed_uniform(seed, *labels, F.lit("s")) * F.col("size")).cast("long")
    begun = steps.filter(fresh).select(*keys, "path", "at", start.alias("start"), "size")
    ended = running(begun, keys=[*keys, "path"], order=["at"], exprs={"__next": ("lag", "at")}, block=index_block("at"), descending=True)
    return ended.select(*keys, "path", "at", "start", (F.coalesce("__next", "size") - F.col("at")).alias("length"), "size")


def path_moments(series: DataFrame, blocks: DataFrame, *, keys: Sequence[str], value: str, index: str = "idx") -> DataFrame:
    """(keys, path, n, mean, std) of resampled paths, std the sample deviation.

    A block's sum and sum of squares are differences of prefix sums at its ends, so a path costs two
    or three lookups a block and its steps are never written out.  Sums are taken about the series'
    mean; a deviation below rounding (1e-6 of the series' own) is 0.
    """
    keys = list(keys)
    whole = series.groupBy(*keys).agg(F.avg(value).alias("__m"), F.var_samp(value).alias("__v"))
    y = F.col(value) - F.col("__m")
    prefix = running(
        attach(series.select(*keys, index, value), whole, keys), keys=keys, order=[index], block=index_block(index),
        exprs={"__0": ("count", value), "__1": ("sum", y), "__2": ("sum", y * y)},
    ).select(*keys, F.col(index).alias("__at"), "__0", F.coalesce("__1", F.lit(0.0)).alias("__1"), F.coalesce("__2", F.lit(0.0)).alias("__2"))
    last = F.col("start") + F.col("length") - 1
    ends = F.array(
        F.struct(F.least(last, F.col("size") - 1).alias("at"), F.lit(1).alias("sign")),
        F.when(F.col("start") > 0, F.struct((F.col("start") - 1).alias("at"), F.lit(-1).alias("sign"))),
        F.when(last >= F.col("size"), F.struct((last - F.col("size")).alias("at"), F.lit(1).alias("sign"))),
    )
    asked = blocks.select(*keys, "path", F.explode(F.filter(ends, lambda e: e.isNotNull())).alias("__e"))
    # Ends at one place of a path add up before they are looked up.
    asked = asked.groupBy(*keys, "path", F.col("__e.at").alias("__at")).agg(F.sum("__e.sign").alias("__s"))
    sums = asked.join(prefix, [*keys, "__at"]).groupBy(*keys, "path").agg(*[F.sum(F.col("__s") * F.col(f"__{i}")).alias(f"__{i}") for i in range(3)])
    n = F.col("__0")
    var = F.when(n > 1, F.greatest(F.lit(0.0), (F.col("__2") - F.col("__1") * F.col("__1") / n) / (n - 1)))
    out = attach(sums, whole, keys)
    return out.select(
        *keys, "path", n.alias("n"), F.when(n > 0, F.col("__m") + F.col("__1") / n).alias("mean"),
        F.when(var <= 1e-12 * F.col("__v"), 0.0).otherwise(F.sqrt(var)).alias("std"),
    )


def bootstrap_sharpe_blocks(
    series: DataFrame, *, keys: Sequence[str], value: str, n_paths: int, block_length: float | Column, seed: int,
    pcts: Sequence[float] = (5.0, 50.0, 95.0), index: str = "idx",
) -> DataFrame:
    """`bootstrap_sharpe` of the paths `stationary_bootstrap` would draw, without writing them out."""
    blocks = bootstrap_blocks(series, keys=keys, n_paths=n_paths, block_length=block_length, seed=seed, index=index)
    moments = path_moments(series, blocks, keys=keys, value=value, index=index)
    sharpe = F.when(F.col("std") > 0, F.col("mean") / F.col("std")).otherwise(0.0)
    return _sharpe_summary(moments.select(*keys, "path", sharpe.alias("sharpe")), series, keys=list(keys), value=value, pcts=pcts)


def bootstrap_sharpe(paths: DataFrame, series: DataFrame, *, keys: Sequence[str], value: str, pcts: Sequence[float] = (5.0, 50.0, 95.0)) -> DataFrame:
    """Nearest-rank percentiles of the per-path Sharpe ratio next to the realised one."""
    return _sharpe_summary(_ratio(paths, [*keys, "path"], value, "sharpe"), series, keys=list(keys), value=value, pcts=pcts)


def _ratio(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    agg = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    return agg.select(*by, F.when(F.col("__s") > 0, F.col("__m") / F.col("__s")).otherwise(0.0).alias(name))


def _sharpe_summary(per_path: DataFrame, series: DataFrame, *, keys: list[str], value: str, pcts: Sequence[float]) -> DataFrame:
    # One value per path: the group size is the number of paths asked for.
    cut = per_path.groupBy(*keys).agg(
        *[F.expr(f"percentile_disc({p / 100.0}) WITHIN GROUP (ORDER BY sharpe)").alias(f"p{p:g}") for p in pcts],
        F.count(F.lit(1)).alias("n_paths"),
    )
    return cut.join(_ratio(series, keys, value, "realized_sharpe"), keys)
