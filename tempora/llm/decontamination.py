"""Benchmark decontamination on templates.

Numbers, names and units of documents and benchmark items become typed placeholders, so that a
question with other values keeps its template.  Windows of the templates are joined by hash.
Matched windows with the same shift between item and document form one passage; its slots, where
windows matched, must be filled consistently: each value of the item stands for one value of the
document throughout.  A name is a capitalised word within a sentence, and, in whatever case, any
word that is one in some item, so copies in other case or with other line breaks have the template
of their item.  Windows without any word of their own (a table of numbers) count only where the
values are the same too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import SPACE, let, stage

WINDOW, NEEDED, SHORTEST = 8, 6, 5
# Words that are units when they follow a number.
UNITS = "mm|cm|m|km|in|ft|yd|mi|mg|g|kg|t|oz|lb|lbs|ml|cl|l|gal|s|sec|secs|seconds|min|mins|minutes|h|hr|hrs|hours|days|weeks|months|years|kmh|mph|hz|khz|mhz|ghz|w|kw|mw|v|a|j|kj|kcal|pa|kpa|bar|c|f|k|usd|eur|gbp|dollars|euros|pounds|cents|percent|degrees|metres|meters|kilometres|kilometers|grams|kilograms|litres|liters|miles|feet|inches"
NAME, NUMBER, UNIT = "\u0002", "\u0003", "\u0004"
#: A capitalised word that does not open a text or sentence.
A_NAME = r"(?<=[^.!?:\s][\x20\x09-\x0D])(\p{Lu}\p{Ll}+)"


def templates(text: Column) -> tuple[Column, Column]:
    """The words of a text without punctuation, names marked; and the words of its template, one for one."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), A_NAME, NAME + "$1")
    bare = F.regexp_replace(marked, r"[^\p{L}\p{M}\p{N}\x02\x20\x09-\x0D]+", "")
    canon = F.regexp_replace(F.regexp_replace(bare, NAME + r"\p{L}[\p{L}\p{M}\p{N}]*", NAME), r"\p{N}+", NUMBER)
    canon = F.regexp_replace(F.lower(canon), NUMBER + r"([\x20\x09]?)(?:" + UNITS + r")(?![\p{L}\p{M}\p{N}])", NUMBER + "$1" + UNIT)
    cut = lambda t: F.filter(F.split(t, SPACE), lambda w: w != "")
    return cut(bare), cut(canon)


def window_hashes(words: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` words; the widths double, so a window costs a few hashes.

    Every width names the one before it several times, so each is bound by ``let`` and worked out once.
    """
    def wider(by: int):
        return lambda h: F.zip_with(h, F.slice(h, by + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    def hashes(words: Column) -> Column:
        h, width = F.transform(words, lambda w: F.xxhash64(w)), 1
        while width < size:
            by = min(width, size - width)
            h, width = let(h, wider(by)), width + by
        return F.slice(h, 1, F.greatest(F.size(words) - (size - 1), F.lit(0)))

    return let(words, hashes)


def with_names(canon: Column, names: list[str]) -> Column:
    """The template's words with those that are among ``names`` made placeholders."""
    return F.transform(canon, lambda w: F.when(w.isin(*names), F.lit(NAME)).otherwise(w)) if names else canon


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, needed: int = NEEDED) -> DataFrame:
    """Verdict of every row: doc_id, contaminated, item_ids, n_windows (the most of one passage).

    ``docs`` needs doc_id and text, ``benchmark`` item_id (of any type) and text; other columns are
    ignored.  A passage counts with ``needed`` different windows of ``window`` words, or all of a
    shorter item's, and slots that are consistent or the same.  Items of fewer than ``window`` words
    are one window; items below five words are not searched.  Null and empty texts are clean.
    Repeated rows get one verdict, as do rows with a null doc_id that share a text.  A repeated item
    counts once, one without an id contaminates but cannot be listed.  Empty tables give an empty
    result or clean documents.  The names of the benchmark (its distinct capitalised words) travel
    with the plan, its windows are joined.
    """
    bare, canon = templates(F.col("text"))
    items = benchmark.select(F.col("item_id"), F.xxhash64("item_id", "text").alias("item"), bare.alias("bare"), canon.alias("canon"))
    items = stage(items.withColumn("n", F.size("canon")).where(F.col("n") >= SHORTEST).dropDuplicates(["item"]).withColumn("width", F.least("n", F.lit(window))))
    marked = items.select(F.explode("bare").alias("w")).where(F.col("w").startswith(NAME)).select(F.lower(F.expr("substring(w, 2)")).alias("w")).where("w <> ''").distinct()
    names = sorted(r.w for r in marked.collect())
    items = items.withColumn("canon", with_names(F.col("canon"), names))
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most window - 4 numbers
    row = F.xxhash64("doc_id", "text")
    d = docs.select("doc_id", row.alias("row"), with_names(canon, names).alias("canon"))
    hits, sought = None, None
    for width in widths:
        w = items.where(F.col("width") == width).select("item", "canon", F.posexplode(window_hashes(F.col("canon"), width)).alias("at", "h"))
        # A window that an item repeats is sought once, so a run of equal words meets another in as many rows as it is long.
        w = w.groupBy("item", "h").agg(F.min_by(F.struct("at", "canon"), "at").alias("first"))
        own = F.exists(F.slice("first.canon", F.col("first.at") + 1, width), lambda c: ~c.rlike(f"[{NAME}{NUMBER}{UNIT}]"))
        w = stage(w.select("item", "h", F.col("first.at").alias("at"), own.alias("own")))
        mine = d.select("doc_id", "row", F.posexplode(window_hashes(F.col("canon"), width)).alias("pos", "h"))
        found = mine.join(w, "h").select("doc_id", "row", "item", (F.col("pos") - F.col("at")).alias("shift"), "at", "own", F.lit(width).alias("width"))
        hits = found if hits is None else hits.union(found)
        sought = w if sought is None else sought.union(w)
    if hits is None:
        return docs.select("doc_id", F.lit(False).alias("contaminated"), F.array().cast(f"array<{dict(benchmark.dtypes)['item_id']}>").alias("item_ids"), F.lit(0).cast("long").alias("n_windows"))
    asked = sought.groupBy("item").agg(F.least(F.lit(needed), F.count(F.lit(1))).alias("needed"), F.least(F.lit(needed), F.count(F.when(F.col("own"), 1))).alias("needed_own"))
    passage = hits.groupBy("doc_id", "row", "item", "shift", "width").agg(F.collect_set("at").alias("places"), F.count_distinct(F.when(F.col("own"), F.col("at"))).alias("n_own"))
    passage = passage.withColumn("n_windows", F.size("places")).join(asked, "item")
    passage = stage(passage.where(F.col("n_windows") >= F.col("needed")).join(items.select("item", "item_id", F.col("bare").alias("item_bare"), F.col("canon").alias("item_canon")), "item"))
    # Slots are read from the few documents with a passage.
    texts = docs.select("text", F.col("doc_id").alias("__d"), row.alias("__r")).join(passage.select(F.col("row").alias("__r")).distinct(), "__r", "left_semi").select("__d", "__r", bare.alias("doc_bare")).dropDuplicates(["__d", "__r"])
    p = passage.join(texts, (F.col("row") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__d")))
    value = lambda w: F.lower(F.replace(w, F.lit(NAME), F.lit("")))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda a: F.sequence(a, a + F.col("width") - 1))))
    pairs = F.transform(covered, lambda i: F.struct(value(F.get("doc_bare", i + F.col("shift"))).alias("doc"), value(F.get("item_bare", i)).alias("item"), F.get("item_canon", i).alias("c")))
    p = p.withColumn("pairs", pairs)
    slots = F.array_distinct(F.transform(F.filter("pairs", lambda v: v["c"].rlike(f"[{NAME}{NUMBER}{UNIT}]")), lambda v: F.struct(v["doc"].alias("doc"), v["item"].alias("item"))))
    p = p.withColumn("slots", slots)
    same = F.forall("pairs", lambda v: v["doc"].eqNullSafe(v["item"]))
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda v: v["item"])))
    p = p.where(same | (consistent & (F.col("n_own") > 0) & (F.col("n_own") >= F.col("needed_own"))))
    verdict = p.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("n_windows").alias("n_windows"))
    verdict = stage(verdict.withColumnsRenamed({"doc_id": "__d", "row": "__r"}))
    out = docs.select("doc_id", row.alias("row")).join(verdict, (F.col("row") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left")
    none = F.array().cast(f"array<{dict(benchmark.dtypes)['item_id']}>")
    return out.select("doc_id", F.col("n_windows").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"))
