"""The document operators as registered queries over the driver tables, with their comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import oracles
from tempora.llm.common import read, words
from tempora.llm.decontamination import decontaminate
from tempora.llm.hard_negatives import hard_negatives
from tempora.llm.language_id import language_id
from tempora.llm.line_chunks import dedup_line_chunks
from tempora.llm.mixing import mix
from tempora.llm.near_duplicates import near_duplicates
from tempora.llm.periodic_runs import collapse_runs
from tempora.llm.pseudonyms import KINDS, pseudonymise
from tempora.llm.quality import quality_rules
from tempora.llm.repeated_bytes import remove_repeated_bytes
from tempora.llm.sharding import shard
from tempora.llm.token_counts import token_counts
from tempora.llm.toxicity import toxicity


def op1_toxicity_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity(read(spark, sf_dir, "documents"), labels)


def op2_quality_risk_controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_mix_weighted_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("source", "copies")


def op3_token_counts_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


def op5_pseudonyms_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The documents are invented, so their key need not be kept.
    return pseudonymise(read(spark, sf_dir, "documents"), "key of the synthetic tables").select("doc_id", "text", *[f"n_{k}" for k in KINDS])


def op6_decontaminate_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_near_duplicates_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_line_chunks(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(read(spark, sf_dir, "documents")).drop("removed")


def op10_shard_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = collapse_runs(with_periods(read(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    runs = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), lines.alias("lines"), "collapsed")
    start, length, period = -F.col("top.col2"), F.col("top.length"), -F.col("top.col3")
    return runs.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text; in one document of ten the words from some place on repeat the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    found = words(F.col("text"))
    n, g = F.greatest(F.size(found), F.lit(1)), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice(found, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice(found, F.lit(1), a), repeated), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), changed).otherwise(F.col("text")).alias("text"))


def op12_language_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return language_id(docs, ~held_out).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op13_hard_negatives_one_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f for f in (
        op1_toxicity_classifier_chain, op2_quality_risk_controlled, op3_token_counts_viterbi, op4_mix_weighted_fair_queueing,
        op5_pseudonyms_feistel, op6_decontaminate_templates, op7_near_duplicates_minhash,
        op8_line_chunks, op9_repeated_bytes, op10_shard_label_propagation,
        op11_periodic_runs, op12_language_string_kernel, op13_hard_negatives_one_bit,
    )
}
ORACLE = oracles.ORACLE
