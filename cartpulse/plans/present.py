"""Output shaping shared by registered queries and their SQL oracles.

Registered queries are compared value by value with DuckDB, so they present
results in engine-neutral types: doubles rounded to 8 decimals, integer
arrays as 'a,b,c', double arrays as fixed 6-decimal text, dates as ISO text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartpulse.functions import arrays as A

DIGITS = 8


def present(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), DIGITS)
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.DoubleType, T.FloatType)):
            c = A.col(A.join_doubles(f"`{f.name}`"))
        elif isinstance(t, T.ArrayType):
            c = A.col(A.join_longs(f"`{f.name}`"))
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, T.BooleanType):
            c = c.cast("int")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# SQL-side counterparts (DuckDB dialect)

def r(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {DIGITS})"


def join_longs_sql(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')"


def join_doubles_sql(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: printf('%.6f', round(x, 6))), ',')"
