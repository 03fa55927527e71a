"""Exact ranks and order statistics without collecting or ordering a whole group.

`percentile_disc` keeps every distinct value of a group in one task, and a row_number
over a group orders it in one task.  Here the whole table is dealt out by ranges of
(keys, order), as many as there are shuffle partitions, so a large group spans several
and none is larger than its share; the ranges are written with their number, scanned
on their own and chained by the two-level running scan.  Where the cuts lie never
changes a result: it only decides which task sees a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.plans.running import running
from tempora.session import materialise


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of one row per key; without keys, the one row's values as scalar subqueries."""
    if keys:
        return df.join(per_key, list(keys), "left")
    return df.select("*", *[per_key.select(c).scalar().alias(c) for c in per_key.columns])


def with_slices(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], slices: int | None = None, out: str = "__slice", size: str = "__size") -> DataFrame:
    """Adds the group size and a slice number that grows with `order` inside each key.

    Rows must be distinct in (keys, order): copies would share a slice.
    """
    keys = list(keys)
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(df.repartitionByRange(n, *keys, *order).withColumn(out, F.spark_partition_id().cast("long")))
    parts = cut.groupBy(*keys, out).agg(F.count(F.lit(1)).alias("__in_slice"))
    # A key has as many of these rows as it has slices.
    sized = parts.withColumn(size, F.sum("__in_slice").over(Window.partitionBy(*keys))).drop("__in_slice")
    left, right = cut.alias("l"), sized.alias("r")
    match = F.lit(True)
    for c in [*keys, out]:
        match = match & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, match).select(*[F.col(f"l.{c}").alias(c) for c in df.columns], F.col(f"r.{size}").alias(size), F.col(f"l.{out}").alias(out))


def ranked(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], out: str = "rank", size: str = "n", slices: int | None = None) -> DataFrame:
    """row_number per key by ascending `order` (distinct per key), and the group size."""
    cut = with_slices(df, keys=keys, order=order, slices=slices, size=size)
    return running(cut, keys=keys, order=order, exprs={out: ("count", F.lit(1))}, block=F.col("__slice")).drop("__slice")


def kth_smallest(
    df: DataFrame,
    wanted: DataFrame,
    *,
    keys: Sequence[str],
    value: str,
    k: str = "k",
    out: str = "value_at_k",
    slices: int | None = None,
) -> DataFrame:
    """`wanted` (keys, k and any labels) plus the k-th smallest `value` of the key.

    k counts from 1.  NULL values are not ranked; a k beyond the group gives NULL.
    Equal values are counted before they are ordered.
    """
    keys = list(keys)
    weight = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__w"))
    cut = with_slices(weight, keys=keys, order=[value], slices=slices)
    upto = running(cut, keys=keys, order=[value], exprs={"__upto": ("sum", "__w")}, block=F.col("__slice"))
    asked = wanted.select(*keys, k).distinct()
    hit = upto.join(asked, keys).filter((F.col(k) <= F.col("__upto")) & (F.col(k) > F.col("__upto") - F.col("__w")))
    return wanted.join(hit.select(*keys, k, F.col(value).alias(out)), keys + [k], "left").select(*wanted.columns, out)
