"""Compares queries with their oracles: rows, column names, values regardless of order."""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings module literatur auslastung lit_treffer dok_etiketten mischung".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def compare(df, sql: str, con) -> str:
    """Empty if both agree, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(want) != len(got):
        return f"{len(got)} rows against {len(want)}; e.g. {got[:2]} {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:3]}" if bad else ""


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    folder = sys.argv[1]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, q, sql = connect(folder), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            said = compare(q[name](spark, folder), sql[name], con) if name in sql else f"no oracle; {q[name](spark, folder).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:700]}"
        print(f"{name}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)
