"""Five stages from raw documents to training shards; each works on what the stage before it kept.

Every stage's result is written to the shared folder as Parquet and read back as the next one's
documents.  All stages but the last return the columns of ``documents``; extra columns of the
input travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.common import read, stage
from tempora.llm.decontamination import decontaminate
from tempora.llm.mixing import mix
from tempora.llm.near_duplicates import near_duplicates
from tempora.llm.quality import quality_rules
from tempora.llm.sharding import shard


#: Similarity of near duplicates; at 6 MinHashes a band, links of just 0.80 share none of the 40 bands 5 times in a million.
NEAR_PERCENT, NEAR_ROWS = 80, 6
#: Least window hashes by which documents are linked for sharding.
PASSAGES = 4


def keyed(docs: DataFrame) -> DataFrame:
    """Adds __row, which tells rows apart even where doc_ids repeat or are null; only equal rows share it.

    It starts with the doc_id so that its order is that of the ids (null last), and ends with a
    128-bit digest of the other columns.  It follows from the row alone, so it needs no written copy.
    """
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    others = F.to_json(F.struct(F.lit(0).alias("__"), *[F.col(c) for c in docs.columns if c not in ("doc_id", "text")]))
    digest = F.md5(F.concat(F.coalesce(F.md5("text"), F.lit("null")), others))
    return docs.withColumn("__row", F.concat(F.coalesce(number, F.lit("null")), digest))


def by_row(docs: DataFrame) -> DataFrame:
    """doc_id (the row's key), text and what else an operator reads."""
    return keyed(docs).drop("doc_id").withColumnRenamed("__row", "doc_id")


def once(docs: DataFrame) -> DataFrame:
    """``keyed`` rows, equal ones once; Spark limits each key to one row before it shuffles them."""
    w = Window.partitionBy("__row").orderBy("__row")
    return keyed(docs).withColumn("__turn", F.row_number().over(w)).where("__turn = 1").drop("__turn")


def keep(rows: DataFrame, verdict: DataFrame) -> DataFrame:
    """The ``keyed`` rows whose key is among the doc_ids of ``verdict``."""
    return rows.join(verdict.select(F.col("doc_id").alias("__row")).distinct(), "__row", "left_semi").drop("__row")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or a risk-controlled cutoff rejects.

    Every row is judged on its own text; equal rows stay or go together.  A label counts for all rows
    of its doc_id, labels of null ids for none.  Null, empty and short texts fail the base rule.
    """
    ids = keyed(docs).select("doc_id", "__row")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").join(ids, "doc_id").select(F.col("__row").alias("doc_id"), "quality")
    return keep(keyed(docs), quality_rules(by_row(docs), labels).where("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near duplicates: the one with the least doc_id, null ids last.

    Ties between different rows go by a digest, of equal rows one stays.  Texts without words are near
    nothing: they stay, equal rows once.
    """
    return keep(once(docs), near_duplicates(by_row(docs), rows=NEAR_ROWS, percent=NEAR_PERCENT).where("kept"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark question, with the same or other values.

    Every row is judged on its own text; equal rows stay or go together.  Null and empty texts stay.
    """
    return keep(keyed(docs), decontaminate(by_row(docs), read(spark, sf_dir, "benchmark")).where(~F.col("contaminated")))


def in_proportion(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by the mix: a row that it takes twice stands twice, one that it does not take is left out.

    Equal rows stand as often as the mix takes them together.  Rows without words cost nothing and
    stand as often as the mix passes their place.
    """
    taken = mix(by_row(docs)).groupBy(F.col("doc_id").alias("__row")).agg(F.sum("copies").cast("int").alias("__copies")).where("__copies > 0")
    rows = once(docs).join(taken, "__row")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix; copies and documents with common passages go together where quotas allow it.

    Equal rows and rows with null ids are rows of their own, null and empty texts a group each.
    """
    return shard(docs, passages=PASSAGES)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", in_proportion),
    ("sharding", in_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs


#: Label propagation and MinHash cannot be said in SQL; tests/llm/test_pipeline.py has a plain version of the stages.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE = {}
