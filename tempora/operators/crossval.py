"""Purged and combinatorial cross-validation splits as tables.

Observations carry `dt` and `label_end`.  A split assigns every observation one role:
test, purged, embargo or train.  The output has one row per observation and split,
which is the result itself; block bounds are a parameter-sized array per key, so no
range join is needed.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.operators.curves import scorecard
from tempora.operators.resample import nearest_rank_small
from tempora.plans.ranks import attach, ranked
from tempora.plans.running import running


def _check(n_groups: int, k_test: int, embargo_pct: float) -> None:
    if n_groups < 2:
        raise ValueError(f"need at least 2 groups, got {n_groups}")
    if not 1 <= k_test < n_groups:
        raise ValueError(f"k_test must be in [1, {n_groups}), got {k_test}")
    if not 0.0 <= embargo_pct < 1.0:
        raise ValueError(f"embargo_pct must be in [0, 1), got {embargo_pct}")


def contiguous_folds(obs: DataFrame, k: int, *, keys: Sequence[str] = (), order: Sequence[str] = ("dt",)) -> DataFrame:
    """Adds obs_idx (from 0), n_obs and fold; the first n mod k folds get one more.

    `order` must tell the observations of a key apart.  The position comes from a
    sliced ranking and the fold from arithmetic on it.
    """
    placed = ranked(obs, keys=list(keys), order=list(order), out="__rank", size="n_obs")
    idx = F.col("__rank") - 1
    small, extra = F.floor(F.col("n_obs") / k), F.col("n_obs") % k
    edge = extra * (small + 1)
    fold = F.when(idx < edge, F.floor(idx / (small + 1))).otherwise(extra + F.floor((idx - edge) / F.greatest(small, F.lit(1))))
    return placed.select(*obs.columns, idx.cast("long").alias("obs_idx"), "n_obs", fold.cast("int").alias("fold"))


def fold_bounds(folds: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """One row per fold: first and last position and date (these end dates bound purging)."""
    return folds.groupBy(*keys, "fold").agg(
        F.min("obs_idx").alias("idx_start"), F.max("obs_idx").alias("idx_end"),
        F.min("dt").alias("dt_start"), F.max("dt").alias("dt_end"), F.max("n_obs").alias("n_obs"),
    )


def _splits(folds: DataFrame, splits: DataFrame, embargo_pct: float, keys: Sequence[str]) -> DataFrame:
    """Roles of every observation in every split; `splits` has split_id (0, 1, ...) and groups."""
    bounds = fold_bounds(folds, keys=keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("fold", "dt_start", "dt_end", "idx_end"))).alias("__b")
    )
    every = F.explode(F.sequence(F.lit(0), splits.agg(F.max("split_id")).scalar()))
    rows = attach(folds, bounds, list(keys)).withColumn("split_id", every).join(splits, "split_id")
    gap = F.floor(F.col("n_obs") * F.lit(float(embargo_pct)))
    groups = F.col("groups")
    block = lambda g: F.get("__b", g)
    overlaps = F.exists(groups, lambda g: (F.col("dt") <= block(g)["dt_end"]) & (F.col("label_end") >= block(g)["dt_start"]))
    after = F.exists(groups, lambda g: (F.col("obs_idx") > block(g)["idx_end"]) & (F.col("obs_idx") <= block(g)["idx_end"] + gap))
    role = F.when(F.array_contains(groups, F.col("fold")), "test").when(overlaps, "purged").when(after, "embargo").otherwise("train")
    return rows.select(*keys, "split_id", "obs_idx", "dt", role.alias("role"))


def purged_kfold(obs: DataFrame, *, k: int, embargo_pct: float = 0.05, keys: Sequence[str] = (), order: Sequence[str] = ("dt",)) -> DataFrame:
    """(split_id, obs_idx, dt, role) of k contiguous test folds."""
    _check(k, 1, embargo_pct)
    return _splits(contiguous_folds(obs, k, keys=keys, order=order), split_table(obs.sparkSession, k, 1), embargo_pct, keys)


def walk_forward(obs: DataFrame, *, train_end: str, test_start: str, keys: Sequence[str] = ()) -> DataFrame:
    """One split: train before train_end, test from test_start on; nothing is purged."""
    if train_end > test_start:
        raise ValueError("train_end must not be after test_start")
    kind = obs.schema["dt"].dataType
    role = F.when(F.col("dt") < F.lit(train_end).cast(kind), "train").when(F.col("dt") >= F.lit(test_start).cast(kind), "test")
    return obs.select(*keys, "dt", role.alias("role")).filter(F.col("role").isNotNull())


def combinations(n_groups: int, k_test: int) -> list[tuple[int, ...]]:
    """Test-group choices in lexicographic order, as `split_table` numbers them; for small choices."""
    return list(itertools.combinations(range(n_groups), k_test))


def unrank(number: Column, n_groups: int, k_test: int) -> Column:
    """The `number`-th (from 0) of the ascending choices of k_test of n_groups groups, in lexicographic order.

    Groups are passed in turn: as many choices take a group next as there are ways to fill the places
    after it from the groups after it; a number below that takes the group, a larger one is less by that.
    """
    ways = F.array(*[F.array(*[F.lit(math.comb(m, j)).cast("long") for j in range(k_test)]) for m in range(n_groups)])
    start = F.struct(number.cast("long").alias("left"), F.lit(k_test).alias("need"), F.array().cast("array<int>").alias("taken"))

    def look(state: Column, group: Column) -> Column:
        here = F.get(F.get(ways, F.lit(n_groups - 1) - group), F.greatest(state["need"] - 1, F.lit(0)))
        take = (state["need"] > 0) & (state["left"] < here)
        left = F.when((state["need"] > 0) & ~take, state["left"] - here).otherwise(state["left"])
        taken = F.when(take, F.concat(state["taken"], F.array(group))).otherwise(state["taken"])
        return F.struct(left.alias("left"), (state["need"] - take.cast("int")).alias("need"), taken.alias("taken"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n_groups - 1)), start, look, lambda state: state["taken"])


def split_table(spark: SparkSession, n_groups: int, k_test: int) -> DataFrame:
    """(split_id, groups) of every choice, worked out from its number; the plan does not grow with their number."""
    total = math.comb(n_groups, k_test)
    if total >= 1 << 31:
        raise ValueError(f"{total} splits are more than can be numbered")
    return spark.range(total).select(F.col("id").cast("int").alias("split_id"), unrank(F.col("id"), n_groups, k_test).alias("groups"))


def cpcv_splits(
    obs: DataFrame, *, n_groups: int, k_test: int, embargo_pct: float = 0.05, keys: Sequence[str] = (), order: Sequence[str] = ("dt",)
) -> DataFrame:
    """(split_id, obs_idx, dt, role) of every choice of k_test test groups."""
    _check(n_groups, k_test, embargo_pct)
    return _splits(contiguous_folds(obs, n_groups, keys=keys, order=order), split_table(obs.sparkSession, n_groups, k_test), embargo_pct, keys)


def split_groups(spark: SparkSession, n_groups: int, k_test: int) -> DataFrame:
    """(split_id, group): the test groups of each split."""
    return split_table(spark, n_groups, k_test).select("split_id", F.explode("groups").alias("group"))


def path_count(n_groups: int, k_test: int) -> int:
    return k_test * math.comb(n_groups, k_test) // n_groups


def cpcv_paths(spark: SparkSession, n_groups: int, k_test: int) -> DataFrame:
    """(path, group, split_id): path j takes the j-th split that tests each group."""
    _check(n_groups, k_test, 0.0)
    nth = F.row_number().over(Window.partitionBy("group").orderBy("split_id")) - 1
    return split_groups(spark, n_groups, k_test).select(nth.alias("path"), "group", "split_id")


def dq_cv_inputs(obs: DataFrame, *, groups: int, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: missing dates, missing horizons, repeated dates, fewer rows than groups."""
    agg = obs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("dt").isNull(), 1)).alias("null_dt"),
        F.count(F.when(F.col("label_end").isNull(), 1)).alias("null_label_end"),
        F.count(F.when(F.col("label_end") < F.col("dt"), 1)).alias("horizon_before_dt"),
        F.count_distinct("dt").alias("n_dt"), F.count("dt").alias("with_dt"),
    )
    labels = [
        ("null_dt", F.col("null_dt") > 0), ("null_label_end", F.col("null_label_end") > 0),
        ("horizon_before_dt", F.col("horizon_before_dt") > 0), ("repeated_dt", F.col("n_dt") < F.col("with_dt")), ("too_few", F.col("n") < groups),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in labels]), lambda x: x.isNotNull())
    return agg.select(*keys, F.explode(found).alias("problem"))


def dq_path_partition(paths: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Path cells whose split does not test the group, and paths that miss a group."""
    wrong = paths.join(groups, ["split_id", "group"], "left_anti").select("path", "group", F.lit("not_tested").alias("problem"))
    every = paths.select("path").distinct().withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    gaps = every.join(paths, ["path", "group"], "left_anti").select("path", "group", F.lit("missing").alias("problem"))
    return wrong.unionByName(gaps)


def segments_of(curves: DataFrame, folds: DataFrame, *, keys: Sequence[str] = ("curve_id",)) -> DataFrame:
    """Curve rows with the group whose first-to-last date holds them; other rows are dropped.

    `folds` is unkeyed, so its bounds are one array of as many entries as groups.
    """
    bounds = fold_bounds(folds).agg(F.collect_list(F.struct("fold", "dt_start", "dt_end"))).scalar()
    inside = F.filter("__b", lambda b: F.col("dt").between(b["dt_start"], b["dt_end"]))
    placed = curves.withColumn("__b", bounds).withColumn("group", F.get(inside, F.lit(0))["fold"])
    return placed.filter(F.col("group").isNotNull()).select(*keys, "group", "dt", "nav")


def _seams(segments: DataFrame, by: Sequence[str]) -> DataFrame:
    return segments.groupBy(*by, "group").agg(
        F.min_by("nav", "dt").alias("__first"), F.try_divide(F.max_by("nav", "dt"), F.min_by("nav", "dt")).alias("__growth"),
        F.min("dt").alias("__from"), F.max("dt").alias("__to"),
    )


def stitch_paths(segments: DataFrame, paths: DataFrame, *, keys: Sequence[str] = ("curve_id",), capital: float = 1.0) -> DataFrame:
    """(keys, path, group, dt, nav): group segments chained so that each seam is 0%.

    `segments` may carry split_id; without it all splits share a group's segment.
    """
    keys = list(keys)
    at = ["split_id", "group"] if "split_id" in segments.columns else ["group"]
    seam_by = keys + [c for c in at if c != "group"]
    cells = _seams(segments, seam_by).join(paths, at)
    level = running(
        cells, keys=keys + ["path"], order=["group"], exprs={"__l": ("product", "__growth")}, exclusive=True
    ).select(*keys, "path", *at, (F.lit(float(capital)) * F.coalesce("__l", F.lit(1.0)) / F.nullif(F.col("__first"), F.lit(0.0))).alias("__scale"))
    return segments.join(level, keys + at).select(*keys, "path", "group", "dt", (F.col("nav") * F.col("__scale")).alias("nav"))


def dq_stitch(segments: DataFrame, *, keys: Sequence[str] = ("curve_id",)) -> DataFrame:
    """Groups whose first date is not after the previous group's last date."""
    spans = _seams(segments, keys)
    lagged = running(spans, keys=list(keys), order=["group"], exprs={"__before": ("lag", "__to")})
    return lagged.filter(F.col("__from") <= F.col("__before")).select(*keys, "group")


def cpcv_evaluate(
    curves: DataFrame, folds: DataFrame, paths: DataFrame, *, keys: Sequence[str] = ("curve_id",), capital: float = 1.0,
    periods_per_year: int = 252, pcts: Sequence[float] = (10.0, 50.0, 90.0),
) -> tuple[DataFrame, DataFrame]:
    """(scorecard per path, nearest-rank percentiles of the Sharpe ratio per curve).

    Flat paths are left out of both; a path too short to judge keeps its status.
    """
    keys = list(keys)
    stitched = stitch_paths(segments_of(curves, folds, keys=keys), paths, keys=keys, capital=capital)
    cards = scorecard(stitched.drop("group"), keys=keys + ["path"], periods_per_year=periods_per_year)
    cards = cards.filter(F.col("status") != "flat")
    # A curve has as many paths as the splits allow: a parameter, so the group is small.
    return cards, nearest_rank_small(cards.filter(F.col("status") == "ok"), keys=keys, value="sr_hat", pcts=pcts)


def path_family(family: str) -> str:
    """Trial family of path results, kept apart so they do not deflate the study itself."""
    return f"{family}::cpcv_paths"
