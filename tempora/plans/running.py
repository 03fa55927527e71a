"""Running aggregates, rolling frames and islands over ordered keys.

A plain window puts one key into one task.  That is fine for daily tables, where
(key, date) is unique and a key can never hold more rows than there are dates.
It is not fine for free timestamps or numbers, where one key may hold a third of
the table.  `block` cuts each key into pieces; every piece is scanned on its own, the
pieces are summarised (one row each), the summaries are scanned per key, and the carry
is joined back.  It is an expression that grows with the order column, or RANGES: the
table is range-partitioned by key and order, so pieces are of even size whatever the
type of the order column, however rows lie on it, and with or without keys.
`auto_block` picks none for keyed dates and RANGES for all else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.session import materialise

BLOCK = "__block"


RANGES = "ranges"


def auto_block(df: DataFrame, order: str, keys: Sequence[str] = ("key",)) -> str | None:
    """No block for the DATE order column of a keyed table, RANGES for all other types and for tables without keys."""
    return None if keys and isinstance(df.schema[order].dataType, T.DateType) else RANGES


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df` with BLOCK, the number of its range of (keys, order).

    Equal (keys, order) share a range.  The number is that of the task, so the result has to be
    written before anything reads it twice.
    """
    return df.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn(BLOCK, F.spark_partition_id().cast("long"))


def index_block(index: str, size: int = 1 << 16) -> Column:
    """Blocks of `size` consecutive positions of an integer index column."""
    return F.floor(F.col(index) / F.lit(size))


def _frame(keys: Sequence[str], order: Sequence[Column], exclusive: bool):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)


def _scan(op: str, value: Column, w) -> Column:
    if op == "sum":
        return F.sum(value).over(w)
    if op == "count":
        return F.count(value).over(w)
    if op == "max":
        return F.max(value).over(w)
    if op == "min":
        return F.min(value).over(w)
    if op == "product":
        return F.product(value).over(w)
    if op == "xor":
        return F.bit_xor(value).over(w)
    if op in ("last", "lag"):
        return F.last(value, ignorenulls=True).over(w)
    raise ValueError(f"unknown running operation {op!r}")


def _whole(op: str, value: Column, position: Column) -> Column:
    if op in ("last", "lag"):
        return F.max_by(value, F.when(value.isNotNull(), position))
    return {
        "sum": F.sum, "count": F.count, "max": F.max, "min": F.min,
        "product": F.product, "xor": F.bit_xor,
    }[op](value)


def _combine(op: str, carry: Column, inner: Column) -> Column:
    if op in ("sum", "count"):
        return F.when(carry.isNull(), inner).when(inner.isNull(), carry).otherwise(carry + inner)
    if op == "product":
        return F.when(carry.isNull(), inner).when(inner.isNull(), carry).otherwise(carry * inner)
    if op == "xor":
        return F.when(carry.isNull(), inner).when(inner.isNull(), carry).otherwise(carry.bitwiseXOR(inner))
    if op == "max":
        return F.greatest(carry, inner)
    if op == "min":
        return F.least(carry, inner)
    return F.coalesce(inner, carry)


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def running(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    exprs: Mapping[str, tuple[str, Column | str]],
    block: Column | str | None = None,
    exclusive: bool = False,
    descending: bool = False,
) -> DataFrame:
    """Add running columns ``{name: (op, value)}``.

    ops: sum, count, max, min, product, xor, last (last non-null value) and lag
    (value of the previous row, null kept; implies an exclusive frame).
    """
    direct = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    ordering = [direct(c) for c in order]
    plan = {}
    for name, (op, value) in exprs.items():
        value = _as_column(value)
        plan[name] = (op, F.struct(value.alias("v")) if op == "lag" else value, exclusive or op == "lag")

    def finish(name: str, op: str, column: Column) -> Column:
        column = column["v"] if op == "lag" else column
        return (F.coalesce(column, F.lit(0)) if op == "count" else column).alias(name)

    if block is None:
        before = Window.partitionBy(*keys).orderBy(*ordering)
        scan = lambda n, op, v, ex: F.lag(v["v"]).over(before).alias(n) if op == "lag" else finish(n, op, _scan(op, v, _frame(keys, ordering, ex)))
        return df.select("*", *[scan(n, *item) for n, item in plan.items()])

    untyped = [c for c, kind in df.dtypes if kind == "void"]
    if untyped:
        # Columns without a type cannot be written.
        scanned = running(df.drop(*untyped), keys=keys, order=order, exprs=exprs, block=block, exclusive=exclusive, descending=descending)
        return scanned.select(*[F.lit(None).alias(c) if c in untyped else F.col(c) for c in df.columns], *exprs)
    cut = list(keys) + [BLOCK]
    blocked = in_ranges(df, keys, order) if isinstance(block, str) else df.withColumn(BLOCK, block.cast("long"))
    # Blocks must follow the scan direction, so a descending scan negates them.
    # Read twice below, so the input is worked out once.
    base = materialise(blocked.withColumn(BLOCK, -F.col(BLOCK) if descending else F.col(BLOCK)))
    position = F.struct(*[F.col(c) for c in order])
    pick = (lambda v: F.min_by(v, F.when(v.isNotNull(), position))) if descending else (lambda v: _whole("last", v, position))
    summary = base.groupBy(*cut).agg(
        *[(pick(v) if op in ("last", "lag") else _whole(op, v, position)).alias(f"__c_{n}") for n, (op, v, _) in plan.items()]
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *cut,
        *[
            (F.sum(f"__c_{n}").over(before) if op == "count" else _scan(op, F.col(f"__c_{n}"), before)).alias(f"__p_{n}")
            for n, (op, _, _) in plan.items()
        ],
    )
    inner = base.select("*", *[_scan(op, v, _frame(cut, ordering, ex)).alias(f"__i_{n}") for n, (op, v, ex) in plan.items()])
    left, right = inner.alias("l"), carried.alias("r")
    match = F.lit(True)
    for c in cut:
        match = match & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = left.join(right, match, "left")
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[finish(n, op, _combine(op, F.col(f"r.__p_{n}"), F.col(f"l.__i_{n}"))) for n, (op, _, _) in plan.items()],
    )


def islands(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    flag: Column,
    out: str = "run_id",
    block: Column | str | None = None,
) -> DataFrame:
    """Number maximal runs of consecutive rows with an equal `flag`."""
    marked = df.withColumn("__flag", flag)
    lagged = running(marked, keys=keys, order=order, exprs={"__prev": ("lag", F.col("__flag"))}, block=block)
    starts = lagged.withColumn("__new", F.when(F.col("__prev").eqNullSafe(F.col("__flag")), 0).otherwise(1))
    return running(starts, keys=keys, order=order, exprs={out: ("sum", F.col("__new"))}, block=block).drop(
        "__flag", "__prev", "__new"
    )


def rolling(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    exprs: Mapping[str, tuple[Column, Column]],
    window: int,
    exclude_current: bool = True,
    block: Column | str | None = None,
    rows_per_block: int = 1 << 16,
) -> DataFrame:
    """Aggregates ``{name: (aggregate, its input)}`` over the `window` rows before
    (or ending at) each row.

    A column is NULL until the frame holds `window` non-NULL inputs.  With `block` set, rows are numbered
    by a blocked scan, cut into index blocks of at least `window` rows, and the last
    `window` rows of each block are copied to the next one as a halo, so no task
    ever sees a whole key.
    """
    lo, hi = (-window, -1) if exclude_current else (1 - window, 0)
    parts = list(keys)
    base = df
    if block is not None:
        size = max(rows_per_block, window)
        numbered = running(df, keys=keys, order=order, exprs={"__n": ("count", F.lit(1))}, block=block)
        home = F.floor((F.col("__n") - 1) / size).cast("long")
        tail = (F.col("__n") - 1) % size >= size - window
        base = (
            numbered.withColumn("__home", home)
            .withColumn(BLOCK, F.explode(F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))))
        )
        parts = parts + [BLOCK]
    w = Window.partitionBy(*parts).orderBy(*order).rowsBetween(lo, hi)
    out = base.select(
        "*", *[F.when(F.count(i).over(w) >= window, e.over(w)).alias(n) for n, (e, i) in exprs.items()]
    )
    if block is not None:
        out = out.filter(F.col(BLOCK) == F.col("__home")).drop("__n", "__home", BLOCK)
    return out


def rolling_moments(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    exprs: Mapping[str, tuple[str, Column | str]],
    window: int,
    exclude_current: bool = True,
) -> DataFrame:
    """`rolling` of ``{name: (op, value)}`` with the ops avg and stddev_pop, without a block.

    A frame of 2n rows is two frames of n rows, one of them lagged by n, so a row merges about log2(window) pairs of
    frames (mean and squared deviations) instead of adding up its whole frame.  A missing row or value leaves NULL.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    first = 1 if exclude_current else 0
    value = {n: f"__v_{n}" for n in exprs}
    mean, dev = {n: f"__m_{n}" for n in exprs}, {n: f"__q_{n}" for n, (op, _) in exprs.items() if op == "stddev_pop"}
    if any(op not in ("avg", "stddev_pop") for op, _ in exprs.values()):
        raise ValueError("rolling_moments knows avg and stddev_pop")
    back = lambda c, by: F.lag(c, by).over(w) if by else F.col(c)

    def merged(rows: DataFrame, n: int, more: int, other_mean, other_dev) -> DataFrame:
        """Frames of n rows and, before them, of `more`; the other frames' columns are taken first."""
        rows = rows.select("*", *[other_mean(i).alias(f"__om_{i}") for i in exprs], *[other_dev(i).alias(f"__oq_{i}") for i in dev])
        gap = {i: F.col(f"__om_{i}") - F.col(mean[i]) for i in exprs}
        return rows.select(
            *df.columns, *value.values(),
            *[(F.col(mean[i]) + gap[i] * (more / (n + more))).alias(mean[i]) for i in exprs],
            *[(F.col(dev[i]) + F.col(f"__oq_{i}") + gap[i] * gap[i] * (n * more / (n + more))).alias(dev[i]) for i in dev],
        )

    out = df.select("*", *[_as_column(v).cast("double").alias(value[n]) for n, (_, v) in exprs.items()])
    out = out.select("*", *[back(value[n], first).alias(mean[n]) for n in exprs])
    # The deviation of one value is 0, of a missing one NULL.
    out = out.select("*", *[(F.col(mean[n]) * 0.0).alias(dev[n]) for n in dev])
    n = 1
    for bit in f"{window:b}"[1:]:
        out = merged(out, n, n, lambda i: back(mean[i], n), lambda i: back(dev[i], n))
        n *= 2
        if bit == "1":
            out = merged(out, n, 1, lambda i: back(value[i], first + n), lambda i: back(value[i], first + n) * 0.0)
            n += 1
    last = lambda i, op: F.sqrt(F.col(dev[i]) / window) if op == "stddev_pop" else F.col(mean[i])
    return out.select(*df.columns, *[last(i, op).alias(i) for i, (op, _) in exprs.items()])
