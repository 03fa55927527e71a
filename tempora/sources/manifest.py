"""Bundle manifests as tables: fingerprints, verification, validation, freshness."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HASHED_SUFFIXES = (".parquet", ".xlsx", ".csv")
#: Bytes of a file that a task holds at a time.
READ_BYTES = 8 << 20

# Days after which a snapshot is worth refreshing, and stale.
WARN_DAYS = 30
STALE_DAYS = 90


def file_row_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows per parquet file; a count needs no data columns."""
    table = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("mergeSchema", "false")
    return table.parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("row_count"))


def _open(path: str):
    """A file as a stream: by the file system its URI names, a plain path by the local one."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return open("/" + (rest or path).lstrip("/"), "rb")  # noqa: SIM115
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inside)


def hash_files(files: DataFrame) -> DataFrame:
    """(path, sha256) of a column of paths; every file is read in blocks into one hash state.

    Files of any size are hashed with READ_BYTES in memory.  Executors open the paths themselves.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                state = hashlib.sha256()
                with _open(path) as stream:
                    while block := stream.read(READ_BYTES):
                        state.update(block)
                yield pd.DataFrame({"path": [path], "sha256": [state.hexdigest()]})

    return files.select("path").mapInPandas(work, "path string, sha256 string")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes) of each hashable file below `path`; contents are not read, and large files get tasks of their own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    wanted = "|".join(s.lstrip(".") for s in HASHED_SUFFIXES)
    return files.select("path", F.col("length").alias("size_bytes")).filter(F.col("path").rlike(rf"\.({wanted})$"))


def fingerprint_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bundle, file, sha256, size_bytes, row_count) of each hashable file below `path`.

    Below `path` lie bundles and in these files, or folders of part files; `file` is the path
    inside the bundle.  If the files lie in `path` itself, it is the bundle.  One row per part
    file; row_count is NULL for files that are no Parquet.
    """
    listed = list_files(spark, path)
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    root = path if "://" not in path else "/" + path.split("://", 1)[1].lstrip("/")
    inside = F.split(F.ltrim(F.substring(plain, F.lit(len(root.rstrip("/")) + 1), F.length("path")), F.lit("/")), "/")
    top = F.when(F.size(inside) > 1, F.get(inside, 0)).otherwise(F.lit(root.rstrip("/").rsplit("/", 1)[-1]))
    file = F.array_join(F.when(F.size(inside) > 1, F.slice(inside, 2, F.size(inside))).otherwise(inside), "/")
    named = listed.select("path", top.alias("bundle"), file.alias("file"), "size_bytes")
    out = named.join(hash_files(listed), "path")
    if not listed.filter(F.col("path").endswith(".parquet")).isEmpty():
        counts = file_row_counts(spark, path).select(F.regexp_replace("path", "^file:/+", "/").alias("__p"), "row_count")
        out = out.withColumn("__p", F.regexp_replace("path", "^file:/+", "/")).join(counts, "__p", "left")
    else:
        out = out.withColumn("row_count", F.lit(None).cast("long"))
    return out.select("path", "bundle", "file", "sha256", "size_bytes", "row_count")


def write_manifest(fingerprints: DataFrame, path: str, *, pull_date: str | dt.date, source: str = "") -> None:
    """Replace the manifest rows of the fingerprinted bundles; other bundles stay."""
    rows = fingerprints.select(
        "bundle", F.lit(source).alias("source"), "file", F.lit(pull_date).cast("date").alias("pull_date"),
        "sha256", "size_bytes", "row_count",
    )
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bundle").parquet(path)
    )


def verify_bundle(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """Violations (bundle, file, violation) between manifest rows and real files."""
    want = manifest.select("bundle", "file", F.col("sha256").alias("__ws"), F.col("size_bytes").alias("__wb"))
    have = actual.select("bundle", "file", F.col("sha256").alias("__hs"), F.col("size_bytes").alias("__hb"))
    kind = (
        F.when(F.col("__hs").isNull(), "missing")
        .when(F.col("__hs") != F.col("__ws"), "sha_mismatch")
        .when(F.col("__hb") != F.col("__wb"), "size_mismatch")
    )
    return (
        want.join(have, ["bundle", "file"], "left").withColumn("violation", kind)
        .filter(F.col("violation").isNotNull()).select("bundle", "file", "violation")
    )


def missing_bundles(requested: DataFrame, manifest: DataFrame) -> DataFrame:
    """Requested bundles the manifest does not know."""
    return requested.select("bundle").distinct().join(manifest.select("bundle").distinct(), "bundle", "left_anti")


def validate_manifest(manifest: DataFrame) -> DataFrame:
    """One row per (bundle, file, problem)."""
    checks = [
        (F.col("bundle").isNull() | (F.col("bundle") == ""), "bundle_missing"),
        (F.col("file").isNull() | (F.col("file") == ""), "file_missing"),
        (F.col("pull_date").isNull(), "pull_date_missing"),
        (~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "sha256_malformed"),
        (F.col("size_bytes").isNull() | (F.col("size_bytes") < 0), "size_invalid"),
        (F.coalesce(F.col("row_count") < 0, F.lit(False)), "row_count_invalid"),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(label)) for c, label in checks]), lambda x: x.isNotNull())
    return manifest.select("bundle", "file", F.explode(found).alias("problem"))


def available_tables(manifest: DataFrame) -> DataFrame:
    """(bundle, table) pairs a manifest declares."""
    return manifest.filter(F.col("file").endswith(".parquet")).select(
        "bundle", F.regexp_replace(F.split_part("file", F.lit("/"), F.lit(1)), r"\.parquet$", "").alias("table")
    ).distinct()


def latest_bundle(manifest: DataFrame, prefix: str) -> DataFrame:
    """The lexicographically greatest bundle name that starts with ``<prefix>_``."""
    return manifest.filter(F.col("bundle").startswith(f"{prefix}_")).agg(F.max("bundle").alias("bundle"))


def freshness(manifest: DataFrame, now: str | dt.datetime) -> DataFrame:
    """Whole days since 16:00 of the pull date, and ok / warn / stale."""
    pulled = F.col("pull_date").cast("timestamp_ntz") + F.expr("interval 16 hours")
    seconds = F.timestamp_diff("SECOND", pulled, F.lit(now).cast("timestamp_ntz"))
    age = F.floor(seconds / 86400).cast("long")
    state = F.when(F.col("age_days") < WARN_DAYS, "ok").when(F.col("age_days") < STALE_DAYS, "warn").otherwise("stale")
    return manifest.select("bundle", "pull_date").distinct().withColumn("age_days", age).withColumn("status", state)
