"""As-of joins without a theta join.

Facts are reduced to one row per (key, time), with map-side combine, unioned with the
requests under a tag, and scanned once: the last payload at or before a request
answers it.  Payload and request travel as one struct each, so columns of one source
row stay together, inner NULLs survive, and neither side is read a second time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.plans.running import auto_block, running


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    payload: Sequence[str],
    direction: str = "backward",
    inclusive: bool = True,
    tie_break: Sequence[str] = (),
    right_unique: bool = False,
    block: Column | str | None = "auto",
    matched: str | None = None,
) -> DataFrame:
    """Attach to each left row the nearest right row of its key.

    ``backward``: greatest right time <= (or <) the left time; ``forward``: the
    smallest >= (or >).  Ties on the right time go to the greatest `tie_break`.
    `matched` adds a boolean telling "no row" apart from "row with NULL fields".
    `right_unique` skips a reduction the caller knows is not needed.  Times may be of any ordered type
    and `by` may be empty; but for keyed dates the scan is cut into even ranges, so no key is one task
    (`block="ranges"` asks for that with dates too, where one key has very many requests a day).
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be backward or forward, got {direction!r}")
    clash = [c for c in payload if c in left.columns]
    if clash:
        raise ValueError(f"payload columns already on the left side: {clash}")
    keys = list(by)
    value = F.struct(*[F.col(c).alias(c) for c in payload])
    facts = right.filter(F.col(right_ts).isNotNull())
    if right_unique:
        facts = facts.select(*keys, F.col(right_ts).alias("__ts"), value.alias("__value"))
    else:
        ranked = F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(tie_break)], value.alias("v"))
        facts = facts.groupBy(*keys, F.col(right_ts).alias("__ts")).agg(F.max(ranked)["v"].alias("__value"))

    asks = left.select(*keys, F.col(left_ts).alias("__ts"), F.struct(*[F.col(c).alias(c) for c in left.columns]).alias("__row"))

    # A request sees facts of its own instant only when the join is inclusive.  The
    # scan runs over (time, tag), reversed for forward joins.
    forward = direction == "forward"
    ask_tag = 1 if inclusive != forward else 0
    stream = facts.select(*keys, "__ts", "__value", F.lit(None).cast(asks.schema["__row"].dataType).alias("__row"), F.lit(1 - ask_tag).alias("__tag"))
    stream = stream.unionByName(
        asks.withColumn("__value", F.lit(None).cast(facts.schema["__value"].dataType)).withColumn("__tag", F.lit(ask_tag))
    )
    if isinstance(block, str) and block == "auto":
        block = auto_block(stream, "__ts", keys)
    scanned = running(
        stream, keys=keys, order=["__ts", "__tag"], exprs={"__hit": ("last", F.col("__value"))},
        block=block, descending=forward,
    ).filter(F.col("__tag") == ask_tag)
    # A NULL key or time matches nothing.
    known = F.col("__ts").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    answers = scanned.select("__row", F.when(known, F.col("__hit")).alias("__hit"))
    extra = [F.col("__hit")[c].alias(c) for c in payload]
    if matched:
        extra.append(F.col("__hit").isNotNull().alias(matched))
    return answers.select(*[F.col("__row")[c].alias(c) for c in left.columns], *extra)
