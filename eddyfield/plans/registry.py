"""Names, callables and SQL oracles of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyfield.plans.fixture import AXIS_SQL, VOXEL_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, body: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Register a query with its SQL: ``body`` over the voxel and axis tables and ``ctes``."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if body is not None:
            ORACLES[name] = "WITH " + ",\n".join([VOXEL_SQL, AXIS_SQL, *ctes]) + "\n" + body
        return function

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round the named columns: sums of doubles depend on the order of the rows."""
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def r(expression: str, name: str, digits: int = 6) -> str:
    """The SQL form of ``rounded`` (adding zero turns -0 into 0)."""
    return f"round({expression}, {digits}) + 0.0 AS {name}"
