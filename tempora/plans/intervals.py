"""Interval joins and interval containment.

`interval_join` returns pairs, so its output is as large as the answer; the equi
key is (key, time bin), which keeps non-matching pairs inside one bin.
`active_at` does not form pairs at all: it counts open intervals with one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.plans.running import running


def _bin(column, width: int):
    return F.floor(F.datediff(column, F.lit("1970-01-01").cast("date")) / F.lit(width)).cast("int")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    *,
    by: Sequence[str],
    at: str,
    start: str,
    end: str,
    how: str = "inner",
    bin_days: int | None = 64,
) -> DataFrame:
    """Pairs with start <= at <= end on equal keys (dates, closed on both sides).

    `bin_days=None` joins on the keys alone; it is the plain form the binned one is
    tested against, and the right choice when a key has a handful of intervals.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError("interval_join supports inner and left_semi")
    keys = list(by)
    p, i = points, intervals
    if bin_days is not None:
        p = p.withColumn("__bin", _bin(F.col(at), bin_days))
        i = i.filter(F.col(start) <= F.col(end)).withColumn(
            "__bin", F.explode(F.sequence(_bin(F.col(start), bin_days), _bin(F.col(end), bin_days)))
        )
        keys = keys + ["__bin"]
    left, right = p.alias("p"), i.alias("i")
    on = (F.col(f"p.{at}") >= F.col(f"i.{start}")) & (F.col(f"p.{at}") <= F.col(f"i.{end}"))
    for k in keys:
        on = on & (F.col(f"p.{k}") == F.col(f"i.{k}"))
    joined = left.join(right, on, how)
    if how == "left_semi":
        return joined.select(*points.columns)
    extra = [F.col(f"i.{c}") for c in intervals.columns if c not in by]
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *extra)


def active_at(
    points: DataFrame,
    intervals: DataFrame,
    *,
    by: Sequence[str],
    at: str,
    start: str,
    end: str,
    ident: str,
    count: str = "n_active",
    out: str = "active_id",
) -> DataFrame:
    """How many intervals of the key are open on each point's date, and which one.

    Every interval adds +1 on its start and -1 on the day after its end (NULL end =
    never).  The running sum is the number of open intervals; the running xor of the
    ids is the id itself whenever exactly one is open, and it is NULLed otherwise.
    Intervals without a start are ignored.  Linear in points + intervals for any
    amount of overlap.
    """
    keys = list(by)
    known = intervals.filter(F.col(start).isNotNull()).select(
        *keys, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(ident).cast("long").alias("__id")
    ).filter(F.col("__e").isNull() | (F.col("__e") >= F.col("__s")))
    edges = known.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("__s").alias("ts"), F.lit(1).alias("d"), F.col("__id").alias("x")),
                F.struct(F.date_add("__e", 1).alias("ts"), F.lit(-1).alias("d"), F.col("__id").alias("x")),
            )
        ).alias("edge"),
    ).select(*keys, "edge.*").filter(F.col("ts").isNotNull())
    asks = points.select(*keys, F.col(at).alias("ts"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("x"), F.lit(1).alias("ask"))
    moments = (
        edges.withColumn("ask", F.lit(0)).unionByName(asks).filter(F.col("ts").isNotNull())
        .groupBy(*keys, "ts").agg(F.sum("d").alias("d"), F.bit_xor("x").alias("x"), F.max("ask").alias("ask"))
    )
    scanned = running(
        moments, keys=keys, order=["ts"],
        exprs={"__n": ("sum", F.col("d")), "__x": ("xor", F.col("x"))},
    ).filter(F.col("ask") == 1)
    answers = scanned.select(
        *keys, F.col("ts").alias(at), F.col("__n").alias(count), F.when(F.col("__n") == 1, F.col("__x")).alias(out)
    )
    return points.join(answers, keys + [at], "left").select(
        *points.columns, F.coalesce(F.col(count), F.lit(0)).cast("long").alias(count), out
    )
