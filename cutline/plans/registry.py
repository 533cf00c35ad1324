"""Name -> query function, and name -> the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cutline.functions.scoring import decimals
from cutline.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    if name in CTES:
        raise ValueError(f"cte {name} defined twice")
    CTES[name] = (needs, sql)


def with_ctes(body: str, needs: tuple[str, ...]) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for n in needs:
        visit(n)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + body


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a query; with ``sql`` it gets an oracle built on the named shared CTEs."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = with_ctes(sql, needs)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with another engine; other columns untouched."""
    return df.select(*[
        decimals(F.col(f"`{n}`"), digits).alias(n) if t == "double"
        else F.round(F.col(f"`{n}`"), digits).alias(n) if t == "float" else F.col(f"`{n}`") for n, t in df.dtypes
    ])


def as_long(c: Column) -> Column:
    return c.cast("bigint")
