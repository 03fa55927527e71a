"""Shards of even size that keep linked documents together, by balanced label propagation.

Documents are linked if their texts are equal and, on request, if they share one of the least
hashes of their word windows, as documents with a common passage are likely to.
Every document starts with a pseudo-random shard as its label.  In each round a document looks at
its neighbours' labels and asks to move to the most frequent one if more neighbours are there
than on its own shard.  A shard admits no more than its free capacity: each asking document is
admitted with probability free / asked.  The last step puts the documents in order of label and
group and cuts that order into shards of exactly even size, so only groups at a cut, or larger
than a shard, are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import stage, words
from tempora.llm.decontamination import window_hashes

ROWS_PER_BUCKET, SHINGLE = 512, 5


def chance(*cols: Column) -> Column:
    """A fixed pseudo-random number in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def propagate(vertices: DataFrame, links: DataFrame, shards: int, rounds: int, slack: float) -> DataFrame:
    """Labels (vid, label) of the linked vertices.

    ``vertices`` has vid and weight, ``links`` a and b (vids).  All vertices count towards the load.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    first = F.floor(chance(F.col("vid"), F.lit("first")) * shards).cast("int")
    ids = both.select(F.col("a").alias("vid")).distinct()
    linked = stage(vertices.join(ids, "vid", "left_semi").select("vid", "weight", first.alias("label")))
    all_load = vertices.groupBy(first.alias("label")).agg(F.sum("weight").alias("load"))
    own = linked.groupBy("label").agg(F.sum("weight").alias("mine"))
    # What the unlinked documents put on each shard; it never changes.
    fixed = stage(all_load.join(own, "label", "left").select("label", (F.col("load") - F.coalesce("mine", F.lit(0))).alias("fixed"), F.sum("load").over(Window.partitionBy()).alias("total")))
    for turn in range(rounds):
        seen = both.join(linked.select(F.col("vid").alias("b"), F.col("label").alias("there")), "b")
        votes = seen.groupBy(F.col("a").alias("vid"), "there").agg(F.count(F.lit(1)).alias("n"))
        asked = linked.join(votes, "vid").groupBy("vid").agg(
            F.first("weight").alias("weight"), F.first("label").alias("label"),
            F.max(F.struct("n", (-F.col("there")).alias("minus"))).alias("best"),
            F.max(F.when(F.col("there") == F.col("label"), F.col("n")).otherwise(F.lit(0))).alias("here"),
        )
        # Half of the vertices may move in a round, or two linked ones would swap places forever.
        free_to_move = (F.col("best.n") > F.col("here")) & (chance(F.col("vid"), F.lit(turn), F.lit("half")) < 0.5)
        asked = stage(asked.select("vid", "weight", "label", F.when(free_to_move, -F.col("best.minus")).otherwise(F.col("label")).alias("goal")))
        load = asked.groupBy("label").agg(F.sum("weight").alias("mine"))
        moving = asked.where(F.col("goal") != F.col("label"))
        demand = moving.groupBy(F.col("goal").alias("label")).agg(F.sum("weight").alias("asked"))
        leaving = moving.groupBy("label").agg(F.sum("weight").alias("leaving"))
        quota = fixed.join(load, "label", "left").join(demand, "label", "left").join(leaving, "label", "left")
        free = slack * F.col("total") / shards - F.col("fixed") - F.coalesce("mine", F.lit(0)) + F.coalesce("leaving", F.lit(0))
        quota = quota.select(F.col("label").alias("goal"), (F.greatest(free, F.lit(0.0)) / F.greatest("asked", F.lit(1))).alias("admit"))
        moved = asked.join(quota, "goal", "left")
        goes = chance(F.col("vid"), F.lit(turn), F.lit("admit")) < F.coalesce("admit", F.lit(1.0))
        linked = stage(moved.select("vid", "weight", F.when(goes, F.col("goal")).otherwise(F.col("label")).alias("label")))
    return linked.select("vid", "label")


def group_links(rows: DataFrame, most: Column) -> DataFrame:
    """Star links between the documents (vid) of a group; one larger than ``most`` becomes linked stars of at most about that size."""
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = rows.join(sizes, "group").withColumn("part", F.floor(chance(F.col("vid"), F.lit("part")) * F.ceil(F.col("n") / most)))
    hubs = stage(member.groupBy("group", "part").agg(F.min("vid").alias("hub")))
    stars = member.join(hubs, ["group", "part"]).select(F.col("vid").alias("a"), F.col("hub").alias("b"))
    chain = hubs.withColumn("before", F.lag("hub").over(Window.partitionBy("group").orderBy("part"))).where("before is not null")
    return stars.union(chain.select(F.col("hub").alias("a"), F.col("before").alias("b"))).where("a != b").distinct()


def least_hashes(text: Column, count: int) -> Column:
    """The ``count`` least hashes of a text's windows of five lower-case words (all, if fewer)."""
    return F.slice(F.sort_array(F.array_distinct(window_hashes(words(F.lower(text)), SHINGLE))), 1, count)


def shard(docs: DataFrame, shards: int = 40, law: str = "rows", rounds: int = 8, slack: float = 1.2, passages: int = 0) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``docs`` needs doc_id and text; other columns are ignored.  Documents of equal text are linked,
    and those that share one of the ``passages`` least hashes of their windows.  law "rows": shards differ by one row
    at most; "bytes": each shard holds an equal share of the bytes, to the size of one document.  Null
    texts count 16 bytes, have a null checksum and form a group; so do empty ones.  Equal rows (and
    null doc_ids) are rows of their own, and which of them gets which slot does not matter.  With
    fewer rows than shards some shards stay empty.  An empty table gives an empty result.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law}")
    text = F.col("text")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    least = [least_hashes(text, passages).alias("__least")] if passages else []
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("group"), *least)
    rows = rows.withColumn("near", F.coalesce(F.unhex(F.hex(F.get("__least", F.lit(0)))), "group") if passages else F.col("group"))
    rows = stage(rows.withColumn("vid", F.xxhash64("doc_id", "group")))
    weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    n_rows = rows.agg(F.count(F.lit(1)).alias("n"))
    vertices = rows.groupBy("vid").agg(F.sum(weight).alias("weight"))
    quarter = F.greatest(n_rows.scalar() / F.lit(4 * shards), F.lit(2))
    links = group_links(rows.select("vid", "group").distinct(), quarter)
    if passages:
        links = links.union(group_links(rows.select("vid", F.explode("__least").alias("group")).distinct(), quarter)).distinct()
        rows = rows.drop("__least")
    labels = propagate(vertices, links, shards, rounds, slack)
    first = F.floor(chance(F.col("vid"), F.lit("first")) * shards).cast("int")
    copies = rows.groupBy("near").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    d = rows.join(labels, "vid", "left").join(copies, "near", "left").withColumn("label", F.coalesce("label", first)).withColumn("copies", F.coalesce("copies", F.lit(1)))
    # The order, in which documents with the least hash in common are neighbours, is cut into buckets of these,
    # and large ones into several, so that no window holds a shard or group.
    d = d.withColumn("zone", F.floor(chance(F.col("near"), F.lit("zone")) * F.ceil(n_rows.scalar() / (shards * ROWS_PER_BUCKET))))
    d = d.withColumn("part", F.floor(chance(F.col("vid"), F.lit("order")) * F.ceil(F.col("copies") / ROWS_PER_BUCKET)))
    d = stage(d.select("doc_id", "size", "text_crc32", "near", "group", "label", "zone", "part"))
    place = ["label", "zone", "part"]
    sums = d.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    before = Window.partitionBy("label").orderBy("zone", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    by_label = sums.groupBy("label").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    earlier = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    by_label = by_label.select(
        "label", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank0"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("offset0"),
        F.sum("n").over(everything).alias("all_rows"), F.sum("bytes").over(everything).alias("all_bytes"),
    )
    sums = sums.join(by_label, "label").select(*place, (F.col("rank") + F.col("rank0")).alias("rank0"), (F.col("offset") + F.col("offset0")).alias("offset0"), "all_rows", "all_bytes")
    inside = Window.partitionBy(*place).orderBy("near", "group", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(sums, place).withColumn("rank", F.col("rank0") + F.row_number().over(inside) - 1).withColumn("end", F.col("offset0") + F.sum("size").over(inside))
    if law == "rows":
        d = d.withColumn("shard", F.expr(f"(rank * {shards}) div all_rows").cast("int"))
    else:
        d = d.withColumn("shard", F.least(F.expr(f"((end - size div 2) * {shards}) div all_bytes"), F.lit(shards - 1)).cast("int"))
    d = stage(d.select("doc_id", "size", "text_crc32", "shard", "rank"))
    starts = d.groupBy("shard").agg(F.min("rank").alias("start"))
    d = d.join(starts, "shard")
    return d.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("rank") - F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
