"""Removal of passages of lines that repeat across documents.

A hash is rolled over every line and the one before it.  A line is a boundary when its rolled hash
is the least of some three in a row: that depends on the lines around it only, so an insertion
shifts no later boundary, and any four lines in a row hold one that all their copies share.  The
two lines that a boundary was rolled over are a chunk.  A line of ``LONG_LINE`` words is a chunk
of its own, instead of the pairs with it: a passage of fewer than four lines may have no boundary.
Chunks that occur more than once are compared by their bytes, and each copy is extended into the
three lines before and behind it as far as they equal those of the first copy.  As chunks follow
each other that closely, these cover a repeated passage from its first line to its last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import WORD, stage

#: A passage of more than 50 words in fewer than four lines has a line of 17.
LONG_LINE, MIN_WORDS = 17, 50
#: Lines looked at on either side of a chunk.
REACH = 3


def n_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def with_chunks(d: DataFrame) -> DataFrame:
    """Adds ``chunks``, structs of first and last line (from 1 on) and hash, for the column ``lines``."""
    d = d.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x))).withColumn("counts", F.transform("lines", n_words))
    rolled = F.zip_with(F.concat(F.array(F.lit(None).cast("long")), "hashes"), "hashes", lambda a, b: F.when(a.isNotNull(), F.xxhash64(a, b)))
    d = d.withColumn("rolled", F.slice(rolled, F.lit(1), F.size("hashes")))

    def least(r: Column, k: Column) -> Column:
        two_before, before, behind, two_behind = (F.coalesce(r <= F.get("rolled", k + j), F.lit(True)) for j in (-2, -1, 1, 2))
        return r.isNotNull() & ((two_before & before) | (before & behind) | (behind & two_behind))

    def short_pair(k: Column) -> Column:
        a, b = F.get("counts", k - 1), F.get("counts", k)
        return (a + b > 0) & (F.greatest(a, b) < LONG_LINE)

    pair = F.transform("rolled", lambda r, k: F.when(least(r, k) & short_pair(k), F.struct(k.alias("first"), (k + 1).alias("last"), r.alias("h"))))
    single = F.transform("hashes", lambda h, k: F.when(F.get("counts", k) >= LONG_LINE, F.struct((k + 1).alias("first"), (k + 1).alias("last"), h.alias("h"))))
    return d.withColumn("chunks", F.filter(F.concat(pair, single), lambda c: c.isNotNull())).drop("hashes", "rolled", "counts")


def runs(numbers: str) -> Column:
    """A column of sorted line numbers as structs (first, last) of consecutive ones."""
    first = F.filter(numbers, lambda x, k: F.coalesce(F.get(numbers, k - 1) < x - 1, F.lit(True)))
    last = F.filter(numbers, lambda x, k: F.coalesce(F.get(numbers, k + 1) > x + 1, F.lit(True)))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def dedup_line_chunks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row without the repeated passages: doc_id, text, n_lines, n_chunks, n_removed_chunks, n_removed_lines.

    ``docs`` needs doc_id and text; other columns are ignored.  A passage goes when it has two lines
    with words, or one line of ``min_words`` words; n_removed_chunks counts passages, and those
    that adjoin are one.  Blank lines go only inside or beside one.  Of equal chunks the one with the least doc_id (null first) and then
    line stays, so a line goes only if an earlier equal one stays.  Lines beside a chunk are compared
    with those of its first copy by 128 bits of SHA-256.  A null text stays null and has no lines; an
    empty text is one empty line.  Rows that repeat doc_id and text are one document and lose the
    same lines.  An empty table gives an empty result.
    """
    row = F.xxhash64("doc_id", "text")
    lines = F.split(F.col("text"), "\n")
    d = with_chunks(docs.select("doc_id", row.alias("row"), lines.alias("lines")))
    # A plain explode would filter by its array first, worked out anew from the text within each lambda.
    found = stage(d.select("doc_id", "row", F.explode_outer("chunks").alias("c")).where("c is not null").select("doc_id", "row", "c.*"))
    # Numbers of places, so that a frequent chunk is reduced before the shuffle by hash aggregation.
    place = F.xxhash64("doc_id", "row", "first", "last")
    repeated = found.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi").select("h")
    suspects = stage(found.join(repeated, "h", "left_semi").groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "last", "h")).alias("cs")))
    # The bytes of suspected chunks only; the chunks of one document are few.  Joins with texts are
    # merge joins at every size, as what they are joined with grows with the input.
    s = suspects.withColumnsRenamed({"doc_id": "__d", "row": "__r"}).hint("merge")
    texts = docs.select("doc_id", "text", row.alias("row")).join(s, (F.col("row") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__d")))
    texts = texts.select("doc_id", "row", lines.alias("lines"), "cs")
    texts = texts.withColumn("digests", F.transform("lines", lambda x: F.unhex(F.substring(F.sha2(x, 256), 1, 32))))
    before, behind = [f"before_{j}" for j in range(REACH)], [f"behind_{j}" for j in range(REACH)]

    def chunk(c: Column) -> Column:
        around = [F.get("digests", c["first"] - 2 - j).alias(x) for j, x in enumerate(before)] + [F.get("digests", c["last"] + j).alias(x) for j, x in enumerate(behind)]
        body = F.array_join(F.slice("lines", c["first"], c["last"] - c["first"] + 1), "\n")
        return F.struct(c["first"].alias("first"), c["last"].alias("last"), c["h"].alias("h"), body.alias("body"), *around)

    each = texts.select("doc_id", "row", F.explode_outer(F.transform("cs", chunk)).alias("c")).where("c is not null").select("doc_id", "row", "c.*")
    at = F.struct("doc_id", "first", "row")
    first_copy = F.struct("doc_id", "first", "row", *before, *behind)
    copies = each.groupBy("h", "body").agg(F.min(first_copy).alias("keeps"), F.max(at).alias("last_one"))
    kept_at = F.struct("keeps.doc_id", "keeps.first", "keeps.row")
    copies = copies.where(~kept_at.eqNullSafe(F.col("last_one"))).select("h", "body", "keeps")
    gone = each.join(copies, ["h", "body"]).where(~at.eqNullSafe(kept_at))

    def reach(names: list[str]) -> Column:
        n = F.lit(len(names))
        for j, x in reversed(list(enumerate(names))):
            n = F.when(F.col(x) == F.col(f"keeps.{x}"), n).otherwise(j)
        return n

    gone = gone.select("doc_id", "row", (F.col("first") - reach(before)).alias("first"), (F.col("last") + reach(behind)).alias("last"))
    gone = gone.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "last")).alias("gone"))
    gone = stage(gone.withColumnsRenamed({"doc_id": "__d", "row": "__r"}))
    out = docs.select("doc_id", "text", row.alias("row")).join(gone.hint("merge"), (F.col("row") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left")
    out = with_chunks(out.select("doc_id", "text", lines.alias("lines"), F.coalesce("gone", F.array().cast("array<struct<first:int,last:int>>")).alias("gone")))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform("gone", lambda g: F.sequence(g["first"], g["last"])))))
    out = out.withColumn("numbers", numbers)

    def is_passage(r: Column) -> Column:
        counts = F.transform(F.slice("lines", r["first"], r["last"] - r["first"] + 1), n_words)
        return (F.size(F.filter(counts, lambda n: n > 0)) > 1) | (F.aggregate(counts, F.lit(0), lambda a, n: a + n) >= min_words)

    out = out.withColumn("passages", F.filter(runs("numbers"), is_passage))
    starts = F.concat(F.array(F.lit(1)), F.transform("passages", lambda r: r["last"] + 1))
    ends = F.concat(F.transform("passages", lambda r: r["first"] - 1), F.array(F.size("lines")))
    left = F.zip_with(starts, ends, lambda a, b: F.slice("lines", a, F.greatest(b - a + 1, F.lit(0))))
    n_gone = F.aggregate("passages", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return out.select(
        "doc_id", F.when(F.size("passages") > 0, F.array_join(F.flatten(left), "\n")).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("n_chunks"),
        F.size("passages").cast("long").alias("n_removed_chunks"), n_gone.cast("long").alias("n_removed_lines"),
    )
