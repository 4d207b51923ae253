"""The table of registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; without SQL only its rows are checked. Results show
    all integers as bigint, as the SQL side does."""

    def register(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = function(tune(spark), sf_dir)
            wide = [F.col(c).cast("bigint") if t == "int" else F.col(c) for c, t in df.dtypes]
            return df.select(*[w.alias(c) for w, c in zip(wide, df.columns)])

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register
