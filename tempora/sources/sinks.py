"""Sinks for curves, metrics and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a file should hold; some tens of MB for curves.
ROWS_PER_FILE = 1 << 21


def write_curves(curves: DataFrame, path: str, *, mode: str = "overwrite", rows_per_file: int = ROWS_PER_FILE) -> int:
    """Curves as parquet, one folder per calendar year so that a year can be read alone.

    Rows are counted and dealt by ranges of (year, curve, day), so files are of about equal size
    however uneven years and curves are, there are at most as many as planned plus one a year, and
    a reader of one curve finds it in neighbouring files.  Returns the number planned.
    """
    files = max(1, -(-curves.count() // rows_per_file))
    placed = curves.withColumn("year", F.year("dt")).repartitionByRange(files, "year", "curve_id", "dt")
    placed.sortWithinPartitions("year", "curve_id", "dt").write.mode(mode).partitionBy("year").parquet(path)
    return files


def write_metrics(metrics: DataFrame, path: str, *, mode: str = "overwrite", rows_per_file: int = ROWS_PER_FILE) -> int:
    """One row per curve, as parquet, in files of about `rows_per_file` rows by ranges of the first column."""
    files = max(1, -(-metrics.count() // rows_per_file))
    metrics.repartitionByRange(files, metrics.columns[0]).write.mode(mode).parquet(path)
    return files
