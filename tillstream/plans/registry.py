"""Query registry and the shared output form of query and oracle.

A spec such as `"store:i date:d sold:f"` names the output columns and their form:
i bigint, s string, d ISO date text, f double at 4 decimals, f6 at 6, f2 at 2.
The same spec shapes the DataFrame and the SQL, so both emit equal bits. Halves are
rounded from slightly below one half (`HALF`): a mean such as 1.00005 is then rounded up
by both engines even where a sum in another order leaves it one bit short.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillstream.plans.oracle_base import with_base
from tillstream.sources.testdata import Tables


HALF = 0.50001


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    spec: str
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, spec: str, sql: str | None = None):
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, spec, sql)
        return fn
    return wrap


def _parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def _spark_col(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "s":
        return c.cast("string").alias(name)
    if kind == "d":
        return F.date_format(c, "yyyy-MM-dd").alias(name)
    scale = 10.0 ** int(kind[1:] or 4)
    return (F.floor(c.cast("double") * scale + HALF).cast("double") / scale).alias(name)


def _sql_col(name: str, kind: str) -> str:
    if kind == "i":
        return f'CAST("{name}" AS BIGINT) AS "{name}"'
    if kind == "s":
        return f'CAST("{name}" AS VARCHAR) AS "{name}"'
    if kind == "d":
        return f"strftime(CAST(\"{name}\" AS DATE), '%Y-%m-%d') AS \"{name}\""
    scale = f"1e{int(kind[1:] or 4)}"
    return f'floor(CAST("{name}" AS DOUBLE) * {scale} + {HALF}e0) / {scale} AS "{name}"'


def present(df: DataFrame, spec: str) -> DataFrame:
    return df.select([_spark_col(n, k) for n, k in _parse(spec)])


def present_sql(sql: str, spec: str) -> str:
    cols = ", ".join(_sql_col(n, k) for n, k in _parse(spec))
    return f"WITH {with_base(sql)}result AS (\n{sql.strip()}\n)\nSELECT {cols} FROM result"


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    q = REGISTRY[name]
    return present(q.build(Tables(spark, sf_dir)), q.spec)


def oracle(name: str) -> str | None:
    q = REGISTRY[name]
    return None if q.sql is None else present_sql(q.sql, q.spec)
