"""Registry of queries: one output schema serves the query and its check.

Column kinds: ``i`` whole number, ``s`` text, ``b`` boolean, ``d`` double as it
is (for fixed-point amounts), ``r<n>`` double rounded to n places, ``t`` date
and ``m`` timestamp as text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landflux.plans.check_sql import SHARED
from landflux.session import configure
from landflux.sources.tables import LandTables

# Rounding bound of the shown doubles, a little off one half: means of decimal
# data often lie exactly on a half, where the last bit of a sum would decide.
HALF = 0.50371


@dataclass
class Entry:
    name: str
    build: Callable[[LandTables], DataFrame]
    columns: dict[str, str]
    body: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(LandTables(configure(spark), folder))
        return df.select(*[_spark_column(c, k).alias(c) for c, k in self.columns.items()])

    def sql(self) -> str | None:
        if self.body is None:
            return None
        picks = ", ".join(f"{_sql_column(c, k)} AS {c}" for c, k in self.columns.items())
        return with_shared(f"SELECT {picks} FROM ({self.body}) AS answer")


REGISTRY: dict[str, Entry] = {}


def query(columns: str, sql: str | None = None):
    """Register the decorated function under its own name."""

    def add(build: Callable[[LandTables], DataFrame]):
        kinds = dict(part.split(":") for part in columns.split())
        REGISTRY[build.__name__] = Entry(build.__name__, build, kinds, sql)
        return build

    return add


def with_shared(statement: str) -> str:
    """Put the shared subqueries a statement names in front of it."""
    needed: set[str] = set()
    waiting = [statement]
    while waiting:
        words = set(re.findall(r"\w+", waiting.pop()))
        for name in SHARED:
            if name in words and name not in needed:
                needed.add(name)
                waiting.append(SHARED[name])
    parts = [f"{name} AS ({text})" for name, text in SHARED.items() if name in needed]
    return f"WITH {', '.join(parts)} {statement}" if parts else statement


def _spark_column(name: str, kind: str) -> Column:
    column = F.col(name)
    if kind[0] == "r":
        scale = float(10 ** int(kind[1:]))
        return F.floor(column.cast("double") * scale + HALF) / scale
    if kind == "t":
        return F.date_format(column, "yyyy-MM-dd")
    if kind == "m":
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return column.cast({"i": "bigint", "s": "string", "b": "boolean", "d": "double"}[kind])


def _sql_column(name: str, kind: str) -> str:
    if kind[0] == "r":
        scale = f"1e{kind[1:]}"
        return f"floor(CAST({name} AS DOUBLE) * {scale} + {HALF}e0) / {scale}"
    if kind == "t":
        return f"strftime({name}, '%Y-%m-%d')"
    if kind == "m":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f')"
    target = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN", "d": "DOUBLE"}[kind]
    return f"CAST({name} AS {target})"
