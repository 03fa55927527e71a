"""Quality rules whose cutoffs come with a guarantee.

Each rule rejects a document when one of its ratios exceeds a cutoff.  For every stratum and
rule the cutoffs are tried from the most lenient one on, over the labelled good documents.
With k of n of these rejected, a cutoff is safe when a false rejection rate of ``alpha`` or
more would give k or fewer rejections with probability ``delta / (strata * rules)`` at most
(the exact binomial test behind the Clopper-Pearson bound).  The trial of a stratum and rule
ends at the first cutoff that is not safe, so the sequence costs no further correction, and
Bonferroni covers the sequences: with probability ``1 - delta``, no rule of any stratum
rejects more than ``alpha`` of the good documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import SPACE_CHARS, stage, words

SYMBOLS = r"[#*$%&|<>]"
# Rules: a ratio and its cutoffs, the most lenient first.
RULES = {
    "symbols": (("n_symbols", "n_words"), (2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1)),
    "capitals": (("n_capitals", "word_chars"), (0.9, 0.8, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "repeats": (("n_repeat_words", "n_words"), (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "lines": (("n_dup_lines", "n_lines"), (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def measures(docs: DataFrame, stratum: str) -> DataFrame:
    """Counts of every whole text: doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.col(stratum).alias("stratum"), text.alias("__text"), words(F.col("text")).alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    w = F.col("__words")
    second, third = F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), F.slice(w, 3, F.greatest(F.size(w), F.lit(1)))
    windows = F.slice(F.zip_with(F.zip_with(w, second, lambda a, b: F.xxhash64(a, b)), third, lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    d = d.select(
        "doc_id", "stratum",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        lines.alias("__lines"),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("__sorted"),
    )
    # Equal windows are neighbours once sorted; a window is repeated if either neighbour equals it.
    s = F.col("__sorted")
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    behind = F.zip_with(s, F.concat(none, s), lambda a, b: F.struct(a["i"].alias("i"), (a["h"] == b["h"]).alias("same"), a["h"].alias("h")))
    both = F.zip_with(behind, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.when(a["same"] | (a["h"] == b["h"]), a["i"]))
    repeated = F.sort_array(F.filter(both, lambda i: i.isNotNull()))
    # Words under windows that start at i: three each, less what the window before covers.
    covered = F.aggregate(repeated, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    return d.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        "n_capitals",
    )


def log_gamma(x: Column) -> Column:
    """Stirling's series, eight steps up; for x of 1 or more."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    steps = F.lit(1.0)
    for i in range(8):
        steps = steps * (x + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) where k is below the mean, else 1.

    The terms fall from k downwards; forty standard deviations below it none is left.
    """
    top = F.exp(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p))
    terms = F.least(k, F.ceil(40 * F.sqrt(n * p)) + 50).cast("int")
    total = F.aggregate(
        F.when(terms > 0, F.sequence(F.lit(0), terms - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, j: F.struct((acc["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("term"), (acc["sum"] + acc["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(k < n * p, top * total).otherwise(F.lit(1.0))


def ratio(rule: str) -> Column:
    part, whole = RULES[rule][0]
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def safe_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """One row per stratum of the good documents and rule: stratum, rule, cutoff (null: none is safe), n_good, n_rejected."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where(F.col("quality") == 1).select("doc_id")
    held = measured.where(~base_failed()).join(good, "doc_id", "left_semi")
    tries = [
        F.sum((ratio(rule) > cut).cast("long")).alias(f"{rule}_{i}") for rule, (_, cuts) in RULES.items() for i, cut in enumerate(cuts)
    ]
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *tries)
    counts = counts.withColumn("n_strata", F.count(F.lit(1)).over(Window.partitionBy()))
    each = [
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("turn"), F.lit(cut).alias("cutoff"), F.col(f"{rule}_{i}").alias("n_rejected"))
        for rule, (_, cuts) in RULES.items() for i, cut in enumerate(cuts)
    ]
    t = counts.select("stratum", "n_good", "n_strata", F.explode(F.array(*each)).alias("t")).select("stratum", "n_good", "n_strata", "t.*")
    t = t.withColumn("chance", binomial_at_most(F.col("n_rejected").cast("double"), F.col("n_good").cast("double"), alpha))
    t = t.withColumn("safe", F.col("chance") <= F.lit(delta) / (F.col("n_strata") * len(RULES)))
    in_turn = Window.partitionBy("stratum", "rule").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("reached", F.min(F.col("safe")).over(in_turn))
    return t.groupBy("stratum", "rule").agg(
        F.max_by(F.when(F.col("reached"), F.col("cutoff")), F.when(F.col("reached"), F.col("turn"))).alias("cutoff"),
        F.max("n_good").alias("n_good"),
        F.max_by(F.when(F.col("reached"), F.col("n_rejected")), F.when(F.col("reached"), F.col("turn"))).alias("n_rejected"),
    )


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """Counts and verdict of every row: doc_id, the counts, base_failed, kept, rejected_by.

    ``docs`` needs doc_id, text and the stratum column, ``labels`` doc_id and quality (1: good);
    other columns are ignored.  A null or empty text has no words and fails the base rule.  A null
    stratum is a stratum of its own.  A document labelled more than once is good if all its labels
    say so; null labels say nothing.  A rule without a safe cutoff (few labels) rejects nothing.
    Repeated rows are judged alike.  An empty table gives an empty result.
    """
    measured = stage(measures(docs, stratum))
    cutoffs = safe_cutoffs(measured, labels, alpha, delta).groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES]
    ).withColumnRenamed("stratum", "__s")
    d = measured.join(cutoffs, F.col("stratum").eqNullSafe(F.col("__s")), "left")
    by = F.concat_ws(",", *[F.when(ratio(rule) > F.col(f"cut_{rule}"), F.lit(rule)) for rule in RULES])
    d = d.withColumn("base_failed", base_failed()).withColumn("rejected_by", by)
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_capitals", "rejected_by")
