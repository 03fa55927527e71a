"""Declared schemas of the vendor tables and of the package's own tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


S, D, F8, I8 = T.StringType(), T.DateType(), T.DoubleType(), T.LongType()

# The column names and types of the vendor files.
SEP = _schema(
    ("ticker", S), ("date", D), ("open", F8), ("high", F8), ("low", F8), ("close", F8), ("closeunadj", F8), ("volume", I8)
)
ACTIONS = _schema(("ticker", S), ("date", D), ("action", S), ("value", F8))
TICKERS = _schema(
    ("permaticker", I8), ("ticker", S), ("name", S), ("exchange", S), ("isdelisted", S), ("firstpricedate", D),
    ("lastpricedate", D), ("firstquarter", D), ("lastquarter", D), ("cusip", S),
)
SF1_KEYS = _schema(
    ("ticker", S), ("dimension", S), ("calendardate", D), ("datekey", D), ("reportperiod", D), ("lastupdated", D)
)
SP500 = _schema(("ticker", S), ("date", D), ("action", S))
MANIFEST = _schema(
    ("bundle", S), ("source", S), ("file", S), ("pull_date", D), ("sha256", S), ("size_bytes", I8), ("row_count", I8)
)
PERFORMANCE = _schema(("period", S), ("annualized_nav_tr_pct", F8), ("annualized_market_price_tr_pct", F8))
DISTRIBUTIONS = _schema(("ex_date", D), ("amount_per_share", F8))
TRIALS = _schema(
    ("dataset_fingerprint", S), ("strategy_family", S), ("sr_hat", F8), ("t_observations", T.IntegerType()),
    ("gamma_3", F8), ("gamma_4", F8), ("metadata_json", S), ("recorded_at", T.TimestampType()),
)

# Fundamentals keep every vendor measure, so only their key columns are declared.
TABLES = {"sep": SEP, "actions": ACTIONS, "sf1": SF1_KEYS, "tickers": TICKERS, "sp500": SP500}
WIDE_TABLES = frozenset({"sf1"})
DATE_COLUMNS = {
    name: [f.name for f in schema.fields if isinstance(f.dataType, T.DateType)] for name, schema in TABLES.items()
}
