"""Per-row status instead of a job-wide failure.

Set operators answer many keys at once, so one bad key must not lose the good
ones.  Each such operator carries a ``status`` column; ``strict=True`` turns any
row whose status is not acceptable into a runtime error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enforce(df: DataFrame, *, strict: bool, context: str, status: str = "status", ok: Sequence[str] = ("ok",)) -> DataFrame:
    if not strict:
        return df
    bad = F.raise_error(F.concat(F.lit(f"{context}: "), F.coalesce(F.col(status), F.lit("missing status"))))
    return df.withColumn(status, F.when(F.col(status).isin(*ok), F.col(status)).otherwise(bad.cast("string")))


def first_status(*rules: tuple[Column, str], default: str = "ok") -> Column:
    """The label of the first rule that holds, else `default`."""
    out = None
    for condition, label in rules:
        out = F.when(condition, F.lit(label)) if out is None else out.when(condition, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def validate_or_raise(violations: DataFrame, message: str, sample: int = 10) -> None:
    """Action: raise when a violations frame has any row (shows at most `sample`)."""
    rows = violations.limit(sample).collect()
    if rows:
        raise ValueError(f"{message}: {[r.asDict() for r in rows]}")
