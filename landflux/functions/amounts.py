"""Column expressions for amounts, units and repeatable random draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landflux.sources.schemas import MONEY

# How many of the target unit one source unit is.
UNITS = {
    ("ha", "m2"): 10000.0,
    ("m2", "ha"): 0.0001,
    ("C", "CO2"): 44.0 / 12.0,
    ("CO2", "C"): 12.0 / 44.0,
    ("t", "kt"): 0.001,
    ("kt", "t"): 1000.0,
    ("kt", "Mt"): 0.001,
    ("Mt", "kt"): 1000.0,
    ("t", "Mt"): 0.000001,
    ("Mt", "t"): 1000000.0,
}
CO2_PER_C = UNITS["C", "CO2"]


def rounded(value: Column, digits: int = 6) -> Column:
    """Round half up in plain floating point, the same in every engine."""
    scale = float(10**digits)
    return F.floor(value.cast("double") * scale + 0.5) / scale


def amount(value: Column) -> Column:
    """An additive amount: fixed point, so that sums do not depend on row order."""
    return rounded(value, 4).cast(MONEY)


def amount_sql(expression: str) -> str:
    """The same for an expression given as text."""
    return f"cast(floor(({expression}) * 10000D + 0.5D) / 10000D as {MONEY})"


def fixed_sql(expression: str) -> str:
    """The expression in whole ten-thousandths: sums of longs are much faster than of decimals."""
    return f"floor(cast({expression} as double) * 10000D + 0.5D)"


def unfixed_sql(expression: str) -> str:
    return f"cast(cast({expression} as decimal(20,0)) * 0.0001BD as decimal(22,4))"


def to_unit(df: DataFrame, column: str, source: str, target: str, out: str | None = None) -> DataFrame:
    if source == target:
        ratio = 1.0
    elif (source, target) in UNITS:
        ratio = UNITS[source, target]
    else:
        raise ValueError(f"no conversion from {source} to {target}")
    return df.withColumn(out or column, F.col(column).cast("double") * ratio)


def uniform_draw(*parts: Column | str) -> Column:
    """A number in (0, 1) fixed by the text of its parts: the same on every retry."""
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(2**32)


def normal_draw(*parts: Column | str) -> Column:
    u1 = uniform_draw(*parts, F.lit("r"))
    u2 = uniform_draw(*parts, F.lit("a"))
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)
