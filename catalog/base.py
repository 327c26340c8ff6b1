"""Registry of queries and the helpers both sides of a check share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL twin when there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column half-even, by the same operations as ``R`` in SQL."""
    cols = {}
    for name, kind in df.dtypes:
        if kind == "double":
            unit = F.lit(float(10 ** special.get(name, digits)))
            cols[name] = F.rint(F.col(name) * unit) / unit + F.lit(0.0)
    return df.withColumns(cols) if cols else df


def R(expression: str, digits: int = 6) -> str:
    return f"(round_even(({expression}) * 1e{digits}, 0) / 1e{digits} + 0.0)"


def uniform_sql(key: str, seed: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {key})), 1, 13))::BIGINT / 4503599627370496.0)"
