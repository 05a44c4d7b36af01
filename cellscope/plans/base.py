"""Registration of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLACES = 6
#: Added before rounding, so that values on a rounding border fall alike whatever their last bit.
NUDGE = 1e-10


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable:
    """Register a query. Doubles of the result are rounded, as those named are in the SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({d} + {NUDGE}, {PLACES}) AS {d}' for d in doubles.split())}) FROM ({sql})" if doubles else sql
        return f

    return put


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c) + NUDGE, PLACES).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
