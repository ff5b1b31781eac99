"""Running compositions along the rows of a key.

A step is a function held in a few columns; two steps in a row are one step of the
same kind again, so a row's composition with all rows before it needs no loop over
them. Each round composes every row with the one 1, 2, 4, ... places before it, all
in one shuffle and one sort by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landflux.session import keep

Step = dict[str, Column]


def running(
    df: DataFrame, by: list[str], order: str, columns: list[str], compose: Callable[[Step, Step], Step], longest: int
) -> DataFrame:
    """``columns`` of every row composed with those of all earlier rows of its key.

    ``compose(earlier, later)`` must be associative; the columns have no nulls and
    ``order`` no ties. A key with more than ``longest`` rows stops the job.
    """
    line = Window.partitionBy(*by).orderBy(order)
    place = F.row_number().over(line)
    df = df.withColumn("_place", place).withColumn(
        "_place",
        F.when(F.col("_place") <= longest, F.col("_place")).otherwise(
            F.raise_error(F.lit(f"more than {longest} rows of one key")).cast("int")
        ),
    )
    reach = 1
    while reach < longest:
        df = df.withColumns({f"_e_{c}": F.lag(c, reach).over(line) for c in columns})
        both = compose({c: F.col(f"_e_{c}") for c in columns}, {c: F.col(c) for c in columns})
        met = F.col("_place") > reach
        df = df.withColumns({c: F.when(met, both[c]).otherwise(F.col(c)) for c in columns})
        df = df.drop(*[f"_e_{c}" for c in columns])
        reach *= 2
    return df.drop("_place")


def clamped(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def compose_clamped(earlier: Step, later: Step) -> Step:
    """Steps x -> min(max(x + add, low), high)."""
    return {
        "add": earlier["add"] + later["add"],
        "low": clamped(earlier["low"] + later["add"], later["low"], later["high"]),
        "high": clamped(earlier["high"] + later["add"], later["low"], later["high"]),
    }


def compose_linear(earlier: Step, later: Step) -> Step:
    """Steps x -> keep * x + come."""
    return {
        "keep": earlier["keep"] * later["keep"],
        "come": earlier["come"] * later["keep"] + later["come"],
    }


def ranged(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` written once in the given order, with a number ``_pos`` that ascends in it.

    Partitions hold neighbouring ranges, so no task sorts more than its share.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(dealt.withColumn("_pos", F.monotonically_increasing_id()), name)


def running_total(placed: DataFrame, value: str, into: str) -> DataFrame:
    """Running sums of ``value`` over a whole ``ranged`` table, in its order.

    Each range is summed on its own, the ranges' sums are added up, one row a
    range, and every row adds what lies before its range to the sum within it.
    """
    part = F.shiftright("_pos", 33)
    numbered = placed.withColumn("_range", part)
    sums = numbered.groupBy("_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.sum("_sum").over(earlier).alias("_before"))
    within = Window.partitionBy("_range").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = numbered.withColumn(into, F.sum(value).over(within)).join(offsets, "_range")
    return summed.withColumn(into, F.col(into) + F.coalesce("_before", F.lit(0))).drop("_range", "_before")
