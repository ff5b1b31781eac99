"""Uncertainty of products, sums and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landflux.functions.amounts import normal_draw

BLOCK = 250


def propagate_product(df: DataFrame, columns: list[str], out: str = "rel_unc") -> DataFrame:
    """Relative uncertainty of a product of independent factors."""
    squares = [F.col(c) * F.col(c) for c in columns]
    return df.withColumn(out, F.sqrt(reduce(lambda a, b: a + b, squares)))


def propagate_sum(parts: DataFrame, by: list[str]) -> DataFrame:
    """Relative uncertainty of a sum of independent parts; null where the sum is zero."""
    x = F.col("amount").cast("double")
    spread = F.sqrt(F.sum(F.pow(x * F.col("rel_unc"), F.lit(2.0))))
    total = F.sum("amount")
    return parts.groupBy(*by).agg(
        total.alias("amount"), F.try_divide(spread, F.abs(total.cast("double"))).alias("rel_unc")
    )


def monte_carlo(parts: DataFrame, by: list[str], draws: int, seed: int) -> DataFrame:
    """Percentiles of totals when each factor is drawn ``draws`` times.

    ``parts`` has ``factor_key``, ``amount`` at the mean factor and ``rel_unc``.
    All amounts that share a factor move together, so they are summed before
    any draw is made: the work is (factors x draws), whatever the number of
    units. Draws come from a hash of seed, factor and draw number. They are made
    in blocks, spread by block and factor over all tasks, and summed per draw in
    each task before the next shuffle.
    """
    z = normal_draw(F.lit(str(seed)), F.col("factor_key"), F.col("draw").cast("string"))
    drawn = F.col("amount").cast("double") * (1 + F.col("rel_unc") * z)
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        parts.groupBy(*by, "factor_key")
        .agg(F.sum("amount").alias("amount"), F.max("rel_unc").alias("rel_unc"))
        .withColumn("_from", F.expr(f"explode(sequence(0, {draws - 1}, {BLOCK}))"))
        .repartition(tasks, "_from", "factor_key")
        .withColumn("draw", F.expr(f"explode(sequence(_from, least(_from + {BLOCK - 1}, {draws - 1})))"))
        .groupBy(*by, "draw")
        .agg(F.sum(drawn).alias("total"))
        .groupBy(*by)
        .agg(
            F.avg("total").alias("mean"),
            F.stddev_samp("total").alias("sd"),
            F.percentile("total", F.lit(0.025)).alias("p025"),
            F.percentile("total", F.lit(0.5)).alias("p500"),
            F.percentile("total", F.lit(0.975)).alias("p975"),
        )
    )
