"""Query registry: a Spark callable and, where SQL can say it, an oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crosswin.functions.expr import col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as query ``name`` covering the survey ids ``ids``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        OPERATORS[name] = ids
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r4(c: Column | str, name: str | None = None) -> Column:
    """Round to 4 places with the same arithmetic as ``sql_r4``; ties are nudged apart."""
    x = F.floor(col(c).cast("double") * 10000.0 + 0.5001) / 10000.0
    return x.alias(name or c)


def sql_r4(e: str) -> str:
    return f"floor(({e})::DOUBLE * 10000.0 + 0.5001) / 10000.0"


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column and widen integers, for comparison only."""
    out = []
    for name, dtype in df.dtypes:
        if dtype in ("double", "float"):
            out.append(r4(name))
        elif dtype in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
