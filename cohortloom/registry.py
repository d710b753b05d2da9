"""Registry of named queries with their column contract and, where SQL can state it, their oracle.

The column contract (``"model:s n:i auc:d"``) is applied to both sides, so the two engines return the same
types and the same rounding: s text, i 64-bit integer, b boolean, d double rounded to six digits (``d4``: four).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Oracle:
    body: str
    prelude: str = ""


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: Oracle | None

    def run(self, spark: SparkSession, sf: str) -> DataFrame:
        df = self.build(spark, sf)
        return df.select(*[_typed(F.col(f"`{c}`"), t).alias(c) for c, t in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        casts = ", ".join(_typed_sql(c, t) for c, t in self.columns)
        return f"{self.sql.prelude}SELECT {casts} FROM ({self.sql.body}) AS answer"


# Added before rounding on both sides: means of short decimals often end exactly half way, where engines differ.
NUDGE = 3.7e-10

QUERIES: dict[str, Query] = {}


def _typed(col, kind: str):
    if kind == "s":
        return col.cast("string")
    if kind == "i":
        return col.cast("bigint")
    if kind == "b":
        return col.cast("boolean")
    return F.round(col.cast("double") + F.lit(NUDGE), int(kind[1:] or 6)) + F.lit(0.0)


def _typed_sql(name: str, kind: str) -> str:
    types = {"s": "VARCHAR", "i": "BIGINT", "b": "BOOLEAN"}
    if kind in types:
        return f'CAST("{name}" AS {types[kind]}) AS "{name}"'
    return f'round(CAST("{name}" AS DOUBLE) + CAST({NUDGE!r} AS DOUBLE), {kind[1:] or 6}) + CAST(0 AS DOUBLE) AS "{name}"'


def query(name: str, columns: str, sql: str | None = None, views: str = ""):
    """Register a query. ``views`` names the fixture views its oracle reads."""
    from cohortloom.plans.fixtures import view_sql

    cols = tuple(tuple(part.split(":")) for part in columns.split())
    oracle = None if sql is None else Oracle(sql, view_sql(views.split()))

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, cols, fn, oracle)
        return fn

    return register
