"""Run registered queries beside their SQL and compare the rows."""

from __future__ import annotations

import math
import time


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for record in records:
        row = []
        for i in order:
            v = record[i]
            if isinstance(v, float) and math.isnan(v):
                v = None
            row.append(v)
        out.append(tuple(row))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, sf_dir: str, name: str, query, sql: str | None):
    import duckdb

    began = time.time()
    df = query(spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    spent = time.time() - began
    if sql is None:
        return f"{name}: rows={len(got)} (no SQL) {spent:.1f}s", len(got) > 0
    con = duckdb.connect()
    for table in (
        "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    ).split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = rows_of(cursor.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return f"{name}: COLUMNS {sorted(df.columns)} vs {sorted(columns)}", False
    if len(got) != len(want):
        return f"{name}: ROWS {len(got)} vs {len(want)}", False
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    if bad:
        return f"{name}: {len(bad)}/{len(got)} rows differ, cols {sorted(columns)} first {bad[:2]}", False
    return f"{name}: ok rows={len(got)} {spent:.1f}s", len(got) > 0
