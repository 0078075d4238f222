"""Run queries on Spark and DuckDB and compare them cell by cell."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if v is None:
            return "\0null"
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    """(ok, seconds, rows, message); exact equality of names, types and values."""
    t = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return True, took, len(got), "rows only"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = [str(d[1]) for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, took, len(got), f"columns {sorted(set(df.columns) ^ set(names))}"
    spark_types = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    bad = {n: (spark_types[n], t) for n, t in zip(names, types) if spark_types[n] != t}
    if bad:
        return False, took, len(got), f"types {bad}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, took, len(got), ""
    cols = sorted(df.columns)
    only = [dict(zip(cols, r)) for r in a if r not in set(b)][:2], [dict(zip(cols, r)) for r in b if r not in set(a)][:2]
    return False, took, len(got), f"rows {len(a)} vs {len(b)}; spark only {only[0]}; oracle only {only[1]}"
