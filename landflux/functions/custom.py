"""User models: grouped fits, vectorised scalars, table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_per_group(
    df: DataFrame,
    keys: list[str],
    x: str,
    y: str,
    fn: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple],
    schema: str,
    step: float = 1.0,
) -> DataFrame:
    """Fit a user model to each group.

    Spark first reduces the group to one point per ``step`` of ``x``: its mean
    ``y``, the number of rows, and their sum of squared deviations from the
    mean. A group is then as small as its range of ``x`` has steps, however many
    rows it had, and travels as one row, so that an Arrow batch brings thousands
    of groups. ``fn`` gets x (the middle of a step), mean y, counts and squared
    deviations as arrays and returns the values of ``schema``. Least squares
    weighted by the counts on the means equals the fit on the rows where x lies
    on the steps; the deviations give its residual variance. Rows without x or y
    are left out.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    packed = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, (F.round(F.col(x).cast("double") / step) * step).alias("_x"))
        .agg(F.avg(y).alias("_y"), F.count(y).alias("_n"), (F.var_pop(y) * F.count(y)).alias("_s"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_x", "_y", "_n", "_s"))).alias("_points"))
        .select(*keys, *[F.col(f"_points.{c}").alias(c) for c in ("_x", "_y", "_n", "_s")])
    )

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = zip(*(batch[c] for c in ("_x", "_y", "_n", "_s")), strict=True)
            fits = [fn(*(np.asarray(part, dtype=float) for part in point)) for point in points]
            yield batch[keys].join(pd.DataFrame(fits, columns=names, index=batch.index))

    return packed.mapInPandas(fit, ", ".join([*[f"{k} {types[k]}" for k in keys], schema]))


def map_factor(
    df: DataFrame,
    column: str,
    fn: Callable[[pd.Series], pd.Series],
    out: str,
) -> DataFrame:
    """Apply a user's vectorised function to one column, in Arrow batches."""

    @F.pandas_udf("double")
    def apply(values: pd.Series) -> pd.Series:
        return fn(values)

    return df.withColumn(out, apply(F.col(column)))


def response_curve_rows(params: DataFrame, total: str, rate: str, years: str) -> DataFrame:
    """``params`` with one row per age: yearly steps of a change that nears its end by a constant rate.

    The last year takes what is left. Rows with a null parameter have no curve.
    """
    left = F.col(total) * F.pow(1 - F.col(rate), F.col("age"))
    share = F.when(F.col("age") == F.col(years) - 1, left).otherwise(left * F.col(rate))
    ages = F.when(F.col(years) > 0, F.sequence(F.lit(0), F.col(years).cast("int") - 1))
    whole = F.col(total).isNotNull() & F.col(rate).isNotNull()
    return params.filter(whole).withColumn("age", F.explode(ages)).withColumn("share", share)


def user_curve_rows(params: DataFrame, fn: Callable[..., Iterator[tuple[int, float]]], columns: list[str]) -> DataFrame:
    """``params`` with the (age, share) rows a user's generator yields for its ``columns``.

    For curves that columns cannot express; the function runs in Python, once a
    row of ``params``.
    """

    class Curve:
        def eval(self, *values):
            yield from fn(*values)

    table = F.udtf(Curve, returnType="age int, share double")
    return params.lateralJoin(table(*[F.col(c).outer() for c in columns]))
