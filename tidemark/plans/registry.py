"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    """Registers a function(spark, sf_dir) under its name; its doubles are rounded, as they are in its SQL."""

    def add(f):
        def run(spark, sf_dir: str) -> DataFrame:
            ship(spark)
            return rounded(f(spark, sf_dir), digits)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return run

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# the modules register their queries when they are imported
from tidemark.plans import backtests, features, learning, market, streams  # noqa: E402, F401
