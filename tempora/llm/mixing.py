"""Mixing sources to target weights by weighted fair queueing.

Every document of a source waits in that source's queue in a fixed pseudo-random order.
Its virtual finish time is the number of source tokens up to and including it, divided by
the source's weight; later passes over the source follow the first.  All queue entries are
put in order of finish time and taken until the token budget is used up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import stage, word_count

ROWS_PER_BUCKET = 512
TIME_SLOTS = 4096


def source_targets(sized: DataFrame, weights: Sequence[float], budget_ratio: float, passes: int) -> DataFrame:
    """One row per source: weight, size, token target and the shared virtual time at which the budget is used up.

    Sources in code point order (null last) take the weights in turn.  A source gives at most
    ``passes`` times its size; what it cannot give is shared by the others by weight, which is
    the level of water over vessels of width ``weight`` and height ``passes * size / weight``.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_height = Window.orderBy("height", "source_rank")
    before = by_height.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_height.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    s = s.withColumn("source_rank", F.row_number().over(ordered))
    turn = F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    s = s.withColumn("most", (F.lit(passes) * F.col("source_size")).cast("double"))
    s = s.withColumn("height", F.col("most") / F.col("weight"))
    s = s.withColumn("budget", F.lit(float(budget_ratio)) * F.sum("source_size").over(everything))
    level = (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onwards)
    s = s.withColumn("__level", level)
    # The level of the first source that it does not fill; if all are filled, the highest one.
    s = s.withColumn("level", F.coalesce(F.min(F.when(F.col("__level") <= F.col("height"), F.struct("height", "source_rank", "__level"))).over(everything)["__level"], F.max("height").over(everything)))
    s = s.withColumn("target", F.least("most", F.col("weight") * F.col("level")))
    return s.drop("__level", "most", "height")


def slot_of(finish: Column) -> Column:
    """Equal steps of virtual time up to the level; nothing far beyond it is ever taken, so it shares one slot."""
    step = F.floor(finish / F.col("level") * TIME_SLOTS)
    return F.when(F.col("level") > 0, F.least(step, F.lit(2 * TIME_SLOTS))).otherwise(F.lit(0))


def mix(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), budget_ratio: float = 1.5, passes: int = 2, seed: int = 0) -> DataFrame:
    """Tokens the mix takes of each document: doc_id, source, size, source_size, target, taken, copies.

    ``docs`` needs doc_id, text and source; other columns are ignored.  A null or empty text has
    size 0 and is taken at no cost.  A null source is a source of its own, last in order.  Equal
    rows are separate documents; which of them comes first does not change the result.  A null
    doc_id is queued under the key "".  An empty table gives an empty result.
    """
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = stage(source_targets(sized, weights, budget_ratio, passes))
    ticket = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # A source of any size is cut into ranges of tickets; sums of ranges give each range its start.
    q = sized.withColumn("ticket", ticket).join(targets.select(F.col("source").alias("__s"), "source_rank", "source_size", "source_rows", "weight", "level", "target"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    share = F.conv(F.substring("ticket", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    q = q.withColumn("bucket", F.floor(share * F.ceil(F.col("source_rows") / ROWS_PER_BUCKET)))
    starts = q.groupBy("source_rank", "bucket").agg(F.sum("size").alias("tokens"))
    starts = starts.withColumn("begin", F.coalesce(F.sum("tokens").over(Window.partitionBy("source_rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    q = q.join(starts.drop("tokens"), ["source_rank", "bucket"])
    inside = Window.partitionBy("source_rank", "bucket").orderBy("ticket", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("served", F.col("begin") + F.sum("size").over(inside)).withColumn("place", F.row_number().over(inside))
    q = stage(q.select("doc_id", "source", "size", "source_rank", "source_size", "weight", "level", "target", "bucket", "place", "served"))

    entry = F.transform(F.array(*[F.lit(p) for p in range(passes)]), lambda p: F.struct(((p * F.col("source_size") + F.col("served")) / F.col("weight")).alias("finish"), F.col("source_rank"), p.alias("turn"), F.col("bucket"), F.col("place")))
    entries = q.select("size", "level", F.explode(entry).alias("at"))
    entries = entries.withColumn("slot", slot_of(F.col("at.finish")))
    budget = targets.agg(F.max("budget").alias("b"))
    slots = entries.groupBy("slot").agg(F.sum("size").alias("tokens"))
    slots = slots.withColumn("through", F.sum("tokens").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))
    # Entries of slots before the last one opened are all taken; within that slot the order decides.
    opened = slots.where(F.col("through") > budget.scalar()).agg(F.min(F.struct("slot", (F.col("through") - F.col("tokens")).alias("begin"))).alias("o"))
    opened = stage(opened.select(F.col("o.slot").alias("slot"), F.col("o.begin").alias("begin")))
    last = entries.where(F.col("slot") == opened.select("slot").scalar())
    last = last.withColumn("total", opened.select("begin").scalar() + F.sum("size").over(Window.partitionBy("slot").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    cut = stage(last.where(F.col("total") <= budget.scalar()).agg(F.max("at").alias("at")))
    lowest, at = opened.select("slot").scalar(), cut.select("at").scalar()
    out = q.withColumn("lowest", lowest).withColumn("cut", at)
    for p in range(passes):
        out = out.withColumn("finish", (F.lit(p) * F.col("source_size") + F.col("served")) / F.col("weight"))
        here = F.struct("finish", "source_rank", F.lit(p).alias("turn"), "bucket", "place")
        out = out.withColumn(f"__{p}", F.col("lowest").isNull() | (slot_of(F.col("finish")) < F.col("lowest")) | ((slot_of(F.col("finish")) == F.col("lowest")) & F.coalesce(here <= F.col("cut"), F.lit(False))))
    copies = sum((F.col(f"__{p}").cast("long") for p in range(passes)), F.lit(0).cast("long"))
    out = out.withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
