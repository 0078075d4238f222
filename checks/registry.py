"""Name -> (Spark query, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

from checks import views as V

QUERIES: dict = {}
SQL: dict = {}


def flat(df: DataFrame) -> DataFrame:
    """Only strings, bigints, doubles and booleans, so both engines print values alike."""
    cols = []
    for f in df.schema:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = f"date_format({c}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        elif isinstance(f.dataType, T.DateType):
            c = f"CAST({c} AS STRING)"
        elif isinstance(f.dataType, T.ArrayType):
            c = f"concat_ws(',', {c})"
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)):
            c = f"CAST({c} AS BIGINT)"
        cols.append(f"{c} AS `{f.name}`")
    return df.selectExpr(*cols)


def reg(name: str, fn, sql: str | None = None) -> None:
    """fn(spark, sf_dir) -> DataFrame."""
    assert name not in QUERIES, name
    QUERIES[name] = lambda spark, sf_dir, fn=fn: flat(fn(spark, sf_dir))
    if sql is not None:
        SQL[name] = sql


def on_usage(op, **params):
    return lambda spark, sf_dir: op(V.usage(spark, sf_dir), as_of=V.AS_OF, **params)
