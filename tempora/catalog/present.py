"""Uniform output of registered queries, in Spark and in the comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles (no negative zero) and print dates, so two engines agree."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def wrap(body: str, columns: str, digits: int = 6) -> str:
    """The SQL side of `present`: "a b:d c:f t:ts" (d = date, f = double, i = integer)."""
    out = []
    for item in columns.split():
        name, _, kind = item.partition(":")
        if kind == "d":
            out.append(f"CAST(CAST({name} AS DATE) AS VARCHAR) AS {name}")
        elif kind == "f":
            out.append(f"round(CAST({name} AS DOUBLE), {digits}) + 0e0 AS {name}")
        elif kind == "ts":
            out.append(f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}")
        elif kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        else:
            out.append(name)
    return f"SELECT {', '.join(out)} FROM ({body}) AS answer"
