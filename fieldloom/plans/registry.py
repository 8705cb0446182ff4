"""Keeps the queries and writes their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DIGITS = 6


@dataclass(frozen=True)
class Tables:
    """The given Parquet tables of one folder."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


SLACK = 1e-4


def half_up_sql(text: str) -> str:
    """Rounding half up that takes a value within 1e-10 of a tie as the tie.

    Engines add a series in different orders; without the slack a sum that lies
    exactly on a tie would round either way.
    """
    return f"floor(({text}) * CAST(1e{DIGITS} AS DOUBLE) + CAST({0.5 + SLACK} AS DOUBLE)) / CAST(1e{DIGITS} AS DOUBLE)"


def rounded(df: DataFrame, slack: bool = False) -> DataFrame:
    """All doubles to the digits compared with the SQL twin."""

    def shown(f: T.StructField) -> str:
        c = f"`{f.name}`"
        if not isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return c
        return f"{half_up_sql(c) if slack else f'round({c}, {DIGITS})'} AS {c}"

    return df.selectExpr(*[shown(f) for f in df.schema.fields])


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _needed(sql: str, seen: list[str]) -> list[str]:
    """Names of the shared subqueries a text uses, in order of use."""
    for name in CTES:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(CTES[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def full_sql(sql: str) -> str:
    names = _needed(sql, [])
    if not names:
        return sql
    parts = [f"{n} AS ({CTES[n].strip()})" for n in names]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None, slack: bool = False):
    """Register a query built from ``Tables``; its doubles are rounded."""

    def keep(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: rounded(build(Tables(spark, folder)), slack)
        if sql is not None:
            ORACLES[name] = full_sql(sql)
        return build

    return keep
